"""Operator 9: secret scans with character Markov models.

Fixed patterns find assignments, access keys and long hex strings. Beyond
them every run of key-like characters is scored by two first-order character
Markov models, one of random strings and one of ordinary identifiers; a run
whose log-likelihood ratio speaks for the random model is a further span of
kind ``markov``. Base spans always stay; where one lies inside a run, what the
run has beside it is judged by itself. A run or rest that isn't random as a
whole is cut at its joints ``/ = _ -`` and its parts are judged.

The models are trained from labelled samples: seeded random strings over the
usual key alphabets and the hex and access keys that the fixed patterns find
are ``random``; all other runs are ``ordinary``. Training rows are a hash
sample of about ``SAMPLE_ROWS`` documents (its bound), counted in parallel;
only the two tables of character pairs reach the driver. Scanning covers
every whole text.

Cases: null text counts as empty and gives no spans. Repeated rows each come
back. Null ids come back null. On an empty table the models are trained from
the seeded strings alone and the result is empty. Other columns are ignored
by ``scan`` and kept by ``redact``, whatever their names. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import arrow_map, table

# --- fixed values ----------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that have 16 or more
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ["assign", "access", "hex", "markov"]
# Runs that the models judge, and the characters that they know.
MIN_RUN = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
JOINTS = "/=_-"
PART = re.compile(r"[A-Za-z0-9+]{16,}")
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
RANDOM_ALPHABETS = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[26:62], ALPHABET[:62] + "_-"]
# Nats per character, and in all, by which the random model must lead.
MIN_RATE, MIN_RATIO = 0.5, 12.0
SAMPLE_ROWS = 2000
SEEDED_STRINGS = 2000
SEED = 20
# ---------------------------------------------------------------------------
_INDEX = np.zeros(128, np.int64)
for _i, _c in enumerate(ALPHABET):
    _INDEX[ord(_c)] = _i + 1  # 0 is the start of a run
SIZE = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _codes(run: str) -> np.ndarray:
    return _INDEX[np.frombuffer(run.encode(), np.uint8)]


def _count(counts: np.ndarray, runs: list[str]) -> None:
    for run in runs:
        c = _codes(run)
        np.add.at(counts, (np.concatenate([[0], c[:-1]]), c), 1)


def beside(spans: list[tuple[int, int, int]], runs: Iterator[re.Match]) -> Iterator[tuple[int, int, bool]]:
    """Of each run, in order, the parts (start, end) that no span covers, and
    whether they are the whole run; spans and runs are passed over once."""
    covered: list[list[int]] = []
    for start, _, end in spans:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    first = 0
    for m in runs:
        at, end = m.span()
        while first < len(covered) and covered[first][1] <= at:
            first += 1
        k, whole = first, True
        while k < len(covered) and covered[k][0] < end:
            whole = False
            if covered[k][0] > at:
                yield at, covered[k][0], False
            at = covered[k][1]
            k += 1
        if at < end:
            yield at, end, whole


def seeded_strings(n: int = SEEDED_STRINGS) -> list[str]:
    rnd = random.Random(SEED)
    return ["".join(rnd.choices(rnd.choice(RANDOM_ALPHABETS), k=rnd.randint(16, 48))) for _ in range(n)]


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each character pair, random over ordinary."""

    def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, SIZE, SIZE), np.int64)
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            _count(counts[0], [text[a:b] for a, kind, b in spans if kind in (1, 2)])
            _count(counts[1], [text[a:b] for a, b, whole in beside(spans, ORDINARY.finditer(text or "")) if whole])
        where = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*where, counts[where])], ["label", "prev", "next", "n"])

    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).select("text")
    counted = arrow_map(sample, pairs, "label long, prev long, next long, n long").groupBy("label", "prev", "next").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, SIZE, SIZE), np.int64)
    for r in counted.collect():  # at most 2 * SIZE * SIZE rows, whatever the input
        counts[r["label"], r["prev"], r["next"]] = r["n"]
    _count(counts[0], seeded_strings())
    smoothed = counts + 0.5
    logs = np.log(smoothed / smoothed.sum(axis=2, keepdims=True))
    return logs[0] - logs[1]


def ratio(model: np.ndarray, run: str) -> float:
    c = _codes(run)
    return float(model[0, c[0]] + model[c[:-1], c[1:]].sum())


def is_random(model: np.ndarray, run: str) -> bool:
    lead = ratio(model, run)
    return lead >= MIN_RATIO and lead >= MIN_RATE * len(run)


def all_spans(text: str, model: np.ndarray) -> list[tuple[int, int, int]]:
    spans = base_spans(text)
    more = []
    for start, end, whole in beside(spans, RUN.finditer(text)):
        if not whole:  # joints to the span beside it belong to neither
            part = text[start:end]
            start, end = end - len(part.lstrip(JOINTS)), start + len(part.rstrip(JOINTS))
        if end - start < MIN_RUN:
            continue
        if is_random(model, text[start:end]):
            more.append((start, 3, end))
            continue
        for m in PART.finditer(text, start, end):
            if m.end() - m.start() < end - start and is_random(model, m[0]):
                more.append((m.start(), 3, m.end()))
    return sorted(spans + more)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """One row per document: counts per base kind, digest of the base spans,
    all spans."""

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text in batch.column("text").to_pylist():
            spans = all_spans(text or "", model)
            base = [s for s in spans if s[1] < 3]
            n = Counter(k for _, k, _ in spans)
            out.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return arrow_map(rows, find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


MASK = "[secret]"


def redact(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """The documents with every span replaced by MASK (overlapping spans as
    one) and ``n_chars``, where there is one, brought up to date."""
    text_at = docs.columns.index("text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, _, b in all_spans(text, model):
            if a >= at:
                out += [text[at:a], MASK]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols = list(batch.columns)
        texts = [clean(t) for t in cols[text_at].to_pylist()]
        if count_at is not None:
            old = cols[count_at].to_pylist()
            before = cols[text_at].to_pylist()
            cols[count_at] = pa.array([n if t == b else len(t) for n, t, b in zip(old, texts, before, strict=True)], batch.schema.field(count_at).type)
        cols[text_at] = pa.array(texts, batch.schema.field(text_at).type)
        yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return arrow_map(docs, over, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every secret is masked; no document goes."""
    return redact(docs, train(docs))
