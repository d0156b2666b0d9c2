"""Operator 10: SentencePiece encoding with seeded merge dropout, and decoding.

Merge-type (BPE) segmentation by agenda: symbol pairs wait in a heap by merge
score, the best is merged, its new neighbours are queued. Each candidate that
comes off the agenda is skipped when its own keyed hash, of (seed, doc_id,
the part's place in the text, i, j, k) for the symbols i to j and j to k, lies
below the dropout rate; a skipped pair stays apart unless a neighbour's merge
queues a wider one. So every occurrence of a word has its own draws, and the
same seed always gives the same pieces. With rate 0 the result is the
library's.

No piece holds a space mark after another character, so a word with the space
marks before it is segmented alone, cut further between characters that stand
side by side in no piece. What a part becomes is a function of the part and of
the candidates skipped, and only that function is kept, in a bounded tree: a
node lists the candidates that come off the agenda when no more are skipped,
with the pieces of that case, and has a child for each candidate to skip next.
Draws are never kept; they are made for all occurrences of a batch at once,
and each occurrence walks from its part's root down to its own node. Parts
over ``KEPT_CHARS`` characters run through the agenda by themselves.
Characters outside the vocabulary are spelt as bytes. Decoding joins the pieces, turns space marks to spaces and
byte pieces to bytes; a space mark that stands in the text itself is spelt as
bytes, so every text comes back exactly.

Cases: null text counts as empty; an empty text has no pieces. Repeated rows
each come back, with the same pieces; null ids share one key. An empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import arrow_map, table
from blobtrail.llm.words import ODD, mixed

# --- fixed values ----------------------------------------------------------
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
RATE = 0.1
SEED = 10
CACHE_UNITS = 120_000
CACHE_NODES = 240_000
KEPT_CHARS = 24  # at most 30: places in a kept part take 5 bits
# Words looked up, and occurrences drawn for, at a time.
WORDS_AT_ONCE, UNITS_AT_ONCE = 4096, 32_768
# ---------------------------------------------------------------------------
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_MODELS: dict = {}
_KEYS: list = []


def load(model_file: str = MODEL_FILE) -> tuple[list[str], list[float], list[bool]]:
    """Pieces, merge scores and byte marks of a model file, for a broadcast
    (its size is the vocabulary's)."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids = range(m.vocab_size())
    pieces = [m.id_to_piece(i) for i in ids]
    whole = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in ids]
    return pieces, [m.get_score(i) if w else float("-inf") for i, w in zip(ids, whole, strict=True)], [m.is_byte(i) for i in ids]


class Segmenter(dict):
    """Maps a word with the space mark before it to the roots of its parts (4
    bytes each, little endian; below 0 for a part too long to be kept).
    ``doc`` is the document whose draws ``encode`` takes."""

    def __init__(self, vocabulary, rate: float, seed: int, doc: int | None = None):
        super().__init__()
        pieces, scores, is_byte = vocabulary
        self.limit, self.seed, self.doc = int(rate * (1 << 53)), seed, doc
        self.score = {p: s for p, s in zip(pieces, scores, strict=True) if s > float("-inf")}
        self.code = {p: i.to_bytes(2, "little") for i, p in enumerate(pieces) if p in self.score}
        self.byte = {}
        self.plain = []
        for i, (p, b) in enumerate(zip(pieces, is_byte, strict=True)):
            if b:
                self.byte[int(p[3:5], 16)] = i.to_bytes(2, "little")
                self.plain.append(bytes([int(p[3:5], 16)]))
            else:
                self.plain.append(p.replace(SPACE, " ").encode() if p in self.score else b"")
        # Neighbours inside some piece: text is cut wherever two aren't.
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.parts, self.long = {}, []
        self._forget()

    def _spelt(self, symbol: str) -> bytes:
        return self.code.get(symbol) or b"".join(self.byte[b] for b in symbol.encode())

    # The tree. Node x: its part, its parent with the candidate skipped there,
    # its pieces, and its candidates first[x] to first[x] + n[x], each with the
    # child that skips it. A candidate is (i, j, k) in 5 bits each.

    def _forget(self) -> None:
        self.clear()
        self.parts.clear()
        self.part_of, self.codes, self.parent, self.skipped = [], [], array("i"), array("i")
        self.first, self.n, self.candidates, self.child = (array("i") for _ in range(4))
        # Root 0 is a space mark that stands in the text itself.
        self._add("", -1, -1, b"".join(self.byte[b] for b in SPACE.encode()), [])

    def _add(self, part: str, parent: int, skipped: int, code: bytes, path: list) -> int:
        self.part_of.append(part)
        self.codes.append(code)
        self.parent.append(parent)
        self.skipped.append(skipped)
        self.first.append(len(self.candidates))
        self.n.append(len(path))
        self.candidates.extend(path)
        self.child.extend([-1] * len(path))
        return len(self.codes) - 1

    def _child(self, node: int, at: int) -> int:
        part, x, skipped, merged, place = self.part_of[node], node, set(), set(), at
        while x >= 0:
            skipped.add(self.candidates[place])
            merged.update(c >> 5 & 31 for c in self.candidates[self.first[x] : place])
            place, x = self.skipped[x], self.parent[x]
        self.child[at] = child = self._add(part, node, at, *self._kept(part, merged, skipped))
        return child

    def _kept(self, part: str, merged=(), skipped=()) -> tuple[bytes, list[int]]:
        """Pieces of a part of few characters, and the candidates on the way,
        from where the borders ``merged`` are gone and ``skipped`` stay. The
        agenda is a list: its best entry, the first of equals, comes next."""
        cuts = [i for i in range(len(part) + 1) if i not in merged]
        score, path = self.score.get, []
        none = float("-inf")
        agenda = [score(part[i:k], none) for i, k in zip(cuts, cuts[2:])]
        if skipped:
            for x in range(len(agenda)):
                if cuts[x] << 10 | cuts[x + 1] << 5 | cuts[x + 2] in skipped:
                    agenda[x] = none
        while agenda:
            best = max(agenda)
            if best == none:
                break
            x = agenda.index(best)
            path.append(cuts[x] << 10 | cuts[x + 1] << 5 | cuts[x + 2])
            del cuts[x + 1], agenda[x]
            if x < len(agenda):
                agenda[x] = score(part[cuts[x] : cuts[x + 2]], none)
            if x:
                agenda[x - 1] = score(part[cuts[x - 1] : cuts[x + 1]], none)
        return b"".join([self.code.get(part[i:k]) or self._spelt(part[i:k]) for i, k in zip(cuts, cuts[1:])]), path

    def __missing__(self, word: str) -> bytes:
        """Roots of a word with the space mark before it, part by part."""
        roots = self._cut(SPACE + word)
        if len(word) <= KEPT_CHARS:
            self[word] = roots
        return roots

    def _cut(self, unit: str) -> bytes:
        pairs, at, out = self.pairs, 0, []
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in pairs:
                out.append(self._root(unit[at:i]))
                at = i
        return np.array(out, "<i4").tobytes()

    def _root(self, part: str) -> int:
        root = self.parts.get(part)
        if root is None:
            if len(part) > KEPT_CHARS + 1:
                self.long.append(part)
                return -len(self.long)
            root = self.parts[part] = self._add(part, -1, -1, *self._kept(part))
        return root

    def segment(self, unit: str, skip: Callable | None = None) -> bytes:
        """Pieces of a part, where ``skip`` tells of a candidate (i, j, k) that
        it is skipped."""
        n, score = len(unit), self.score
        if n == 1:
            return self._spelt(unit)
        end = list(range(1, n + 1))  # end of the symbol that starts at i; 0 where none starts
        prev = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = score.get(unit[i : i + 2])
            if s is not None:
                agenda.append((-s, i, i + 1, i + 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, k = heapq.heappop(agenda)
            if end[i] != j or end[j] != k:
                continue  # one of the two symbols has changed
            if skip is not None and skip((i, j, k)):
                continue
            end[i], end[j] = k, 0
            if k < n:
                prev[k] = i
                s = score.get(unit[i : end[k]])
                if s is not None:
                    heapq.heappush(agenda, (-s, i, k, end[k]))
            p = prev[i]
            if p >= 0:
                s = score.get(unit[p:k])
                if s is not None:
                    heapq.heappush(agenda, (-s, p, i, k))
        out, i = [], 0
        while i < n:
            out.append(self._spelt(unit[i : end[i]]))
            i = end[i]
        return b"".join(out)

    def _skipper(self, base: int) -> Callable | None:
        """The draws of one part, by the hash that ``_nodes`` takes."""
        if not self.limit:
            return None
        known: dict = {}

        def skip(candidate) -> bool:
            if candidate not in known:  # drawn in advance for all starts of that shape
                i, j, k = candidate
                starts = np.arange(i, i + 64, dtype=np.int64)
                shape = np.stack([starts, starts + (j - i), starts + (k - i)], axis=1)
                draws = (mixed(np.uint64(base) ^ candidate_keys(shape)) >> np.uint64(11)) < np.uint64(self.limit)
                known.update(zip(map(tuple, shape.tolist()), draws.tolist(), strict=True))
            return known[candidate]

        return skip

    def _nodes(self, roots: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The node of each occurrence, from its root and its part of the key."""
        held = lambda x: np.frombuffer(x, np.int32)  # noqa: E731  (for one expression: arrays in view can't grow)
        node, keys = roots.astype(np.int64), kept_keys()
        left = np.flatnonzero(held(self.n)[node]) if self.limit else node[:0]
        while len(left):
            n, first = held(self.n)[node[left]].astype(np.int64), held(self.first)[node[left]]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
            draws = mixed(np.repeat(base[left], n) ^ keys[held(self.candidates)[at]]) >> np.uint64(11)
            hit = np.flatnonzero(draws < np.uint64(self.limit))
            row = np.searchsorted(ends, hit, side="right")
            earliest = np.flatnonzero(np.diff(row, prepend=-1))
            left, at = left[row[earliest]], at[hit[earliest]]
            new = np.flatnonzero(held(self.child)[at] < 0)
            for parent, candidate in zip(node[left[new]].tolist(), at[new].tolist(), strict=True):
                if self.child[candidate] < 0:
                    self._child(parent, candidate)
            node[left] = held(self.child)[at]
            left = left[held(self.n)[node[left]] > 0]
        return node

    def _units(self, text: str) -> Iterator[bytes]:
        """Roots of a text, some words at a time."""
        if not text:
            return
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            words = text.split(" ")
            for at in range(0, len(words), WORDS_AT_ONCE):
                yield b"".join(map(self.__getitem__, words[at : at + WORDS_AT_ONCE]))
            return
        mark = bytes(4)
        for k, part in enumerate(text.split(SPACE)):
            if k:
                yield mark
            yield from self._spaced(part, first=k == 0)

    def _spaced(self, text: str, first: bool) -> Iterator[bytes]:
        """Roots of text with runs of spaces; the first of a document also gets
        the model's leading space."""
        marked = (" " + text if first else text).replace(" ", SPACE)
        out = []
        for m in _UNIT.finditer(marked):
            unit = m[0]
            out.append(self[unit[1:]] if unit[0] == SPACE and unit[1:2] != SPACE else self._cut(unit))
            if len(out) == WORDS_AT_ONCE:
                yield b"".join(out)
                out = []
        yield b"".join(out)

    def encode_all(self, docs: Iterable[tuple[int | None, str]]) -> list[bytes]:
        """Piece ids of each (doc_id, text), 2 bytes an id, little endian."""
        out, waiting, n = [], [], 0
        for doc_id, text in docs:
            key, place = document_key(self.seed, doc_id), 0
            out.append([])
            for roots in self._units(text):
                waiting.append((out[-1], key, place, roots))
                place += len(roots) // 4
                n += len(roots) // 4
                if n >= UNITS_AT_ONCE:
                    self._settle(waiting)
                    waiting, n = [], 0
        self._settle(waiting)
        return [b"".join(x) for x in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([(self.doc, text)])[0]

    def _settle(self, waiting: list[tuple[list, int, int, bytes]]) -> None:
        """Draws for all occurrences that wait, and hands out their pieces."""
        if waiting:
            sizes = np.array([len(w[3]) // 4 for w in waiting])
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) + np.repeat(np.array([w[2] for w in waiting]) - ends + sizes + 1, sizes)
            base = mixed(np.repeat(np.array([w[1] for w in waiting], np.uint64), sizes) + places.astype(np.uint64) * ODD)
            roots = np.frombuffer(b"".join(w[3] for w in waiting), "<i4")
            codes = list(map(self.codes.__getitem__, self._nodes(np.maximum(roots, 0), base).tolist()))
            for i in np.flatnonzero(roots < 0).tolist():
                codes[i] = self.segment(self.long[-int(roots[i]) - 1], self._skipper(int(base[i])))
            at = 0
            for (out, *_), end in zip(waiting, ends.tolist(), strict=True):
                out.append(b"".join(codes[at:end]))
                at = end
        self.long.clear()
        if len(self) >= CACHE_UNITS or len(self.codes) >= CACHE_NODES:
            self._forget()

    def decode(self, ids: bytes) -> str:
        joined = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u2").tolist()))
        return joined.decode()[1:]


def document_key(seed: int, doc_id: int | None) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{doc_id}".encode(), digest_size=8).digest(), "little")


def candidate_keys(triples: np.ndarray) -> np.ndarray:
    """A 64-bit value of each candidate (i, j, k)."""
    out = np.zeros(len(triples), np.uint64)
    for c in range(3):
        out = mixed(out * ODD + triples[:, c].astype(np.uint64) + np.uint64(1))
    return out


def kept_keys() -> np.ndarray:
    """The values of all candidates of kept parts, by their 15 bits."""
    if not _KEYS:
        c = np.arange(1 << 15)
        _KEYS.append(candidate_keys(np.stack([c >> 10, c >> 5 & 31, c & 31], axis=1)))
    return _KEYS[0]


def segmenter(vocabulary, rate: float, seed: int, doc: int | None = None) -> Segmenter:
    """The worker's own copy."""
    key = (id(vocabulary), rate, seed, doc)
    if key not in _MODELS:
        _MODELS[key] = Segmenter(vocabulary, rate, seed, doc)
    return _MODELS[key]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _named(batch: pa.RecordBatch) -> list[tuple[int | None, str]]:
    return [(d, t or "") for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]


def encode(docs: DataFrame, model_file: str = MODEL_FILE, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id and ids (array<int>) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in segmenter(shared.value, rate, seed).encode_all(_named(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(_rows(docs), over, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id and text from the ids of ``encode``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_file))

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m = segmenter(shared.value, 0.0, 0)
        texts = [m.decode(np.asarray(x or [], "<u2").tobytes()) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), over, "doc_id long, text string")


def round_trip(docs: DataFrame, model_file: str = MODEL_FILE, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """Encodes and decodes every document and digests both."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, ids_hash, text_hash, same = [], [], [], []
        m, rows = segmenter(shared.value, rate, seed), _named(batch)
        for (_, text), ids in zip(rows, m.encode_all(rows), strict=True):
            back = m.decode(ids)
            n.append(len(ids) // 2)
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(back.encode()).hexdigest())
            same.append(back == text)
        cols = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), pa.array(same, pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_pieces", "ids_sha256", "text_sha256", "lossless"])

    return arrow_map(_rows(docs), over, "doc_id long, n_pieces long, ids_sha256 string, text_sha256 string, lossless boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the piece ids of every document that is left."""
    return encode(docs)
