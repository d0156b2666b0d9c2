"""Operator 6: edit-aware token counts.

Per document a segment tree of its pre-tokens is kept: leaves are runs of up
to ``LEAF`` pre-tokens with their length in characters and their token count,
inner nodes are sums. An edit re-encodes only the leaves that it touches plus
the boundary context: scanning starts at the leaf that holds the character
before the edit (a pre-token ends by what follows it), or the first character
of the whole white-space run that ends there (it is split by what follows it),
or an apostrophe one character further back, and goes on until the
new boundaries fall on an old leaf start behind the edit, from where on the
pre-tokens are the old ones. The touched leaves get their new sums and the
sums on their paths to the root are updated; no other pre-token is counted
again.

Pre-tokens are those of the byte-level vocabulary; the token count of a
pre-token is kept in a bounded cache per worker.

Cases: null text counts as empty (no leaves, 0 tokens). Edits are sorted by
start; they must not overlap and lie inside the text (ends are clipped to it).
A null or empty edit list changes nothing. Repeated rows each come back, null
ids too. An empty table gives no rows. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import bisect
import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import arrow_map, table

# --- fixed values ----------------------------------------------------------
RANKS_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
CACHE_ENTRIES = 250_000
# The edits of the registered query: masked mail addresses and long numbers,
# and one inserted note per document.
MAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+")
NUMBER = re.compile(r"[0-9]{5,}")
NOTE = " [checked]"
# ---------------------------------------------------------------------------
_COUNTERS: dict = {}


class Counter(dict):
    """Token count of a pre-token."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        super().__init__()
        table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=table_, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) < 64:
            self[piece] = n
        return n


def counter(ranks: bytes) -> Counter:
    key = zlib.crc32(ranks)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(ranks)
    return _COUNTERS[key]


def tree_of(leaves: np.ndarray) -> np.ndarray:
    """Sums over ``leaves`` (one row per leaf): node 1 is the root, node k has
    children 2k and 2k + 1, leaf i stands at width + i."""
    width = 1
    while width < len(leaves):
        width *= 2
    nodes = np.zeros((2 * width, leaves.shape[1] if leaves.ndim == 2 else 3), np.int64)
    nodes[width : width + len(leaves)] = leaves
    at = width
    while at > 1:
        nodes[at // 2 : at] = nodes[at : 2 * at].reshape(at // 2, 2, -1).sum(axis=1)
        at //= 2
    return nodes


def build(text: str, count: Counter) -> np.ndarray:
    """Tree over (characters, pre-tokens, tokens) of the leaves."""
    pieces = count.pattern.findall(text)
    n = len(pieces)
    per = np.zeros((-(-n // LEAF) * LEAF, 3), np.int64)
    if n:
        per[:n, 0] = np.fromiter(map(len, pieces), np.int64, n)
        per[:n, 1] = 1
        per[:n, 2] = np.fromiter(map(count.__getitem__, pieces), np.int64, n)
    return tree_of(per.reshape(-1, LEAF, 3).sum(axis=1))


def _put(nodes: np.ndarray, leaf: int, value) -> None:
    """Sets one leaf and brings the sums on its path up to date."""
    at = len(nodes) // 2 + leaf
    change = np.asarray(value) - nodes[at]
    while at:
        nodes[at] += change
        at //= 2


def context(text: str, a: int) -> int:
    """First character whose pre-token an edit at ``a`` can change; -1 before
    the text. White space by ``isspace``, which holds all of the pattern's."""
    at = a - 1
    while at > 0 and text[at].isspace() and text[at - 1].isspace():
        at -= 1
    return at - 1 if at == a - 1 and at > 0 and text[at - 1] == "'" else at


def edited(text: str, nodes: np.ndarray, edits: list[tuple[int, int, str]], count: Counter) -> tuple[str, np.ndarray, int]:
    """New text, updated tree and the number of pre-tokens encoded again.
    ``edits``: (start, end, replacement) in characters of ``text``."""
    edits = sorted((min(a, len(text)), min(max(a, b), len(text)), r) for a, b, r in edits)
    parts, at = [], 0
    for a, b, r in edits:
        parts += [text[at:a], r]
        at = b
    new = "".join([*parts, text[at:]])
    nodes, width = nodes.copy(), len(nodes) // 2
    starts = np.concatenate([[0], np.cumsum(nodes[width:, 0])])  # old leaf starts, then the end
    where = {int(p): i for i, p in reversed(list(enumerate(starts[:-1])))}
    reach = [context(text, a) for a, _, _ in edits]
    recoded, k, shift = 0, 0, 0
    while k < len(edits):
        # Empty leaves share a start; the last of them holds what follows.
        first = max(0, int(np.searchsorted(starts, max(0, reach[k]), side="right")) - 1)
        first = min(first, width - 1)
        pos = int(starts[first]) + shift
        sums, last, done, begun = np.zeros(3, np.int64), width, 0, k
        while True:
            # Take in every edit whose context reaches what has been scanned.
            while k < len(edits) and reach[k] < pos - shift:
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
                done = edits[k - 1][1]
            if pos >= len(new):
                last = width
                break
            old = pos - shift
            if k > begun and old >= done and where.get(old, 0) > first and (k == len(edits) or reach[k] >= old):
                last = where[old]
                break
            m = count.pattern.match(new, pos)
            # An edit that starts inside this pre-token belongs to it.
            while k < len(edits) and reach[k] < m.end() - shift:
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                done = edits[k][1]
                k += 1
            sums += (len(m[0]), 1, count[m[0]])
            pos = m.end()
        recoded += int(sums[1])
        _put(nodes, first, sums)
        for leaf in range(first + 1, last):
            if nodes[width + leaf].any():
                _put(nodes, leaf, (0, 0, 0))
    return new, nodes, recoded


TREE = "doc_id long, text string, tree array<long>"


def build_trees(docs: DataFrame, ranks_file: str = RANKS_FILE) -> DataFrame:
    """doc_id, text and the flat tree (3 numbers a node) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(open(ranks_file, "rb").read())

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        trees = [build(t or "", count).ravel() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(trees, pa.list_(pa.int64()))], ["doc_id", "text", "tree"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), over, TREE)


def apply_edits(trees: DataFrame, edits_of, ranks_file: str = RANKS_FILE) -> DataFrame:
    """Applies the edits that ``edits_of(doc_id, text)`` names to documents
    with trees: new text and tree, counts before and after, pre-tokens encoded
    again."""
    shared = trees.sparkSession.sparkContext.broadcast(open(ranks_file, "rb").read())
    schema = "doc_id long, text string, tree array<long>, n_edits long, tokens_before long, tokens_after long, n_pretokens long, n_recoded long"

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count, out = counter(shared.value), []
        flat = batch.column("tree")
        for i, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            nodes = np.asarray(flat[i].values, np.int64).reshape(-1, 3)
            edits = edits_of(doc, text or "")
            new, after, recoded = edited(text or "", nodes, edits, count) if edits else (text or "", nodes, 0)
            out.append((new, after.ravel(), len(edits), int(nodes[1, 2]), int(after[1, 2]), int(after[1, 1]), recoded))
        kinds = [pa.string(), pa.list_(pa.int64())] + [pa.int64()] * 5
        cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], [x.split()[0] for x in schema.split(", ")])

    return arrow_map(trees, over, schema)


def masking_edits(doc_id: int | None, text: str) -> list[tuple[int, int, str]]:
    """The registered query's edits of a document, in order and apart."""
    mails = [m.span() for m in MAIL.finditer(text)] if "@" in text else []
    found, k = [(a, b, "<mail>") for a, b in mails], 0
    for m in NUMBER.finditer(text):  # both come in order
        while k < len(mails) and mails[k][1] <= m.start():
            k += 1
        if k == len(mails) or m.end() <= mails[k][0]:
            found.append((m.start(), m.end(), "<number>"))
    found.sort()
    at = zlib.crc32(str(doc_id).encode()) % (len(text) + 1)
    before = bisect.bisect_left(found, (at,)) - 1  # the last edit that starts before
    if before < 0 or found[before][1] <= at:
        found.append((at, at, NOTE))
    return sorted(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = build_trees(table(spark, sf_dir, "documents"))
    return apply_edits(trees, masking_edits).drop("text", "tree")
