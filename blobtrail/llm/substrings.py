"""Operator 5: substring dedup with suffix automata of reference shards.

A word goes when a run of ``WINDOW`` words around it also starts in a document
with a smaller id. Which texts can share such a run is found first: equal runs
have the same smallest 4-word hash (their minimiser), so only minimisers that
occur twice matter; of equal texts only the smallest id's is looked at, the
others lose every window. Texts are cut into segments, the maximal runs of
consecutive windows with one minimiser; a minimiser's segments form a shard.

In its shard every document, in id order, is streamed through a suffix
automaton of the segments of smaller documents: matching statistics give at
each word the longest run that ends there and occurs before, and the automaton
state of its last ``WINDOW`` words knows the first document that holds them.
Maximal spans of such words are removed. Decisions are by the words
themselves, hashes only choose the shard.

The corpus has no bound, so automata of all of it are not broadcast: a shard
and the segments that are streamed through it meet by a shuffle. A minimiser of
more than ``SHARD_DOCS`` documents is split, its windows are shards of their
own, whose references are one row per distinct window (a partial aggregation).
Windows that make up a ``HEAVY``-th of all such rows or more, at most ``HEAVY``
by that rule, are the one reference shard whose automaton is broadcast; what
holds them is streamed through it where it stands. So no shard grows with the
corpus, nothing is copied, and no partner is left out. A document sends each of
its distinct segments once, with all places, however often it repeats a line.

Cases: null text has no words. Documents with fewer words than a window keep
all. Repeated rows share an id, so they don't remove each other. A null doc_id
takes no part and keeps all. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import arrow_map, table, text_bytes, written
from blobtrail.llm.words import grams, hashes

# --- fixed values ----------------------------------------------------------
WINDOW = 13
KEY_WORDS = 4
SHARD_DOCS = 1000
HEAVY = 2000
BATCH = 20_000
# ---------------------------------------------------------------------------


class Automaton:
    """Suffix automaton over several word sequences, added in id order; each
    state knows the first document that its runs occur in."""

    def __init__(self):
        self.length, self.link, self.next, self.first = [0], [-1], [{}], [None]

    def add(self, words: list[bytes], doc: int) -> None:
        length, link, nxt, first = self.length, self.link, self.next, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is None:
                cur = len(length)
                length.append(length[last] + 1)
                nxt.append({})
                link.append(0)
                first.append(doc)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur, p = None, last
            clone = len(length)
            length.append(length[p] + 1)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            first.append(first[q])
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = clone
            if cur is None:
                last = clone
            else:
                link[cur] = clone
                last = cur

    def first_docs(self, words: list[bytes]) -> list[int | None]:
        """For each window of ``words``: the first document that holds it."""
        length, link, nxt, first = self.length, self.link, self.next, self.first
        state, matched, out = 0, 0, []
        for at, w in enumerate(words, 1):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            if matched >= WINDOW:
                while length[link[state]] >= WINDOW:
                    state = link[state]
                    matched = length[state]
            if at >= WINDOW:
                out.append(first[state] if matched >= WINDOW else None)
        return out


def minimisers(h: np.ndarray) -> np.ndarray:
    """The minimiser of every window, from word hashes."""
    g = grams(h, KEY_WORDS)
    return np.lib.stride_tricks.sliding_window_view(g, WINDOW - KEY_WORDS + 1).min(axis=1)


def version_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def read_texts(docs: DataFrame) -> DataFrame:
    """doc_id, version (digest of the words), the words, compressed for
    shuffles, and the distinct minimisers of each text: the one pass over
    the texts."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        keys, versions, packed = [], [], []
        for text in text_bytes(batch):
            words = text.split()
            joined = b" ".join(words)
            versions.append(hashlib.blake2b(joined, digest_size=16).digest())
            packed.append(pack.compress(joined))
            keys.append(np.unique(minimisers(hashes(words))).view(np.int64) if len(words) >= WINDOW else [])
        cols = [pa.array(versions, pa.binary()), pa.array(packed, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "version", "packed", "keys"])

    return arrow_map(docs.select("doc_id", "text"), over, "doc_id long, version binary, packed binary, keys array<long>")


SEGMENT = "route long, kind int, doc_id long, version binary, starts array<int>, words binary"
REFERENCE, BOTH, STREAMED = 0, 1, 2


def segments(docs: DataFrame) -> DataFrame:
    """The distinct segments of texts (doc_id, version, packed) with the
    minimisers that other texts hold too, and where they start: whole ones
    for ``cold`` minimisers, single windows for ``hot`` ones."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols = [[] for _ in range(6)]

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])
            for c in cols:
                c.clear()
            return out

        unpack = zstandard.ZstdDecompressor()
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "packed", "cold", "hot")), strict=True)
        for doc, version, packed, cold, hot in rows:
            words = unpack.decompress(packed).split()
            if len(words) < WINDOW:
                continue
            h = hashes(words)
            m = minimisers(h).view(np.int64)
            begin = np.nonzero(np.r_[True, m[1:] != m[:-1]])[0]
            size = np.diff(np.r_[begin, len(m)])
            key = m[begin]
            places: dict[tuple[int, int, bytes], list[int]] = {}
            run = np.isin(key, np.asarray(cold, np.int64))
            for k, a, n in zip(key[run].tolist(), begin[run].tolist(), size[run].tolist(), strict=True):
                places.setdefault((k, BOTH, b" ".join(words[a : a + n + WINDOW - 1])), []).append(a)
            if hot:
                run = np.isin(key, np.asarray(hot, np.int64))
                route = grams(h, WINDOW).view(np.int64)
                for a, n in zip(begin[run].tolist(), size[run].tolist(), strict=True):
                    for i, r in enumerate(route[a : a + n].tolist(), a):
                        places.setdefault((r, STREAMED, b" ".join(words[i : i + WINDOW])), []).append(i)
            for (r, kind, raw), starts in places.items():
                for c, v in zip(cols, (r, kind, doc, version, starts, raw), strict=True):
                    c.append(v)
            if len(cols[0]) >= BATCH:
                yield flush()
        if cols[0]:
            yield flush()

    return arrow_map(docs.select("doc_id", "version", "packed", "cold", "hot"), over, SEGMENT)


SPAN = "doc_id long, version binary, starts array<int>, windows int"


def _spans(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "version", "starts", "windows"])


def heavy_spans(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Spans of the windows among ``rows`` that smaller documents hold, by the
    broadcast automaton of ``heavy`` (route, words, first: at most ``HEAVY``
    rows); rows of other routes pass by."""
    shard = rows.sparkSession.sparkContext.broadcast(sorted((r["first"], r["route"], bytes(r["words"])) for r in heavy.collect()))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, routes = Automaton(), np.array([route for _, route, _ in shard.value], np.int64)
        for first, _, raw in shard.value:
            automaton.add(raw.split(), first)
        for batch in batches:  # a document's windows lie together and give one row
            batch = batch.filter(pa.array(np.isin(batch.column("route").to_numpy(), routes)))
            held: dict[tuple[int, bytes], list[int]] = {}
            for doc, version, starts, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "starts", "words")), strict=True):
                (first,) = automaton.first_docs(raw.split())
                if first is not None and first < doc:
                    held.setdefault((doc, version), []).extend(starts)
            if held:
                yield _spans([[d for d, _ in held], [v for _, v in held], list(held.values()), [1] * len(held)])

    return rows.select("route", "doc_id", "version", "starts", "words").mapInArrow(stream, SPAN)


class Shard:
    """One shard while its segments stream by in id order."""

    def __init__(self):
        self.automaton, self.pending, self.known, self.doc, self.held = None, [], {}, None, []

    def _settle(self) -> None:
        """Segments of the document just finished become references."""
        for words, raw, doc in self.held:
            if raw not in self.known:
                self.known[raw] = doc
                self.pending.append((words, doc))
        self.held = []

    def see(self, kind: int, doc: int, raw: bytes) -> list[tuple[int, int]]:
        """Spans (first window, windows) of a segment that smaller documents
        hold."""
        if doc != self.doc or kind == STREAMED:
            self._settle()
            self.doc = doc
        if kind == REFERENCE:
            self.held.append((raw.split(), raw, doc))
            return []
        words = None
        earlier = self.known.get(raw)
        if earlier is not None and earlier < doc:
            return [(0, raw.count(b" ") + 2 - WINDOW)]
        words = raw.split()
        spans = []
        if self.known:
            if self.automaton is None:
                self.automaton = Automaton()
            for held, held_doc in self.pending:
                self.automaton.add(held, held_doc)
            self.pending = []
            for at, first in enumerate(self.automaton.first_docs(words)):
                if first is not None and first < doc:
                    if spans and spans[-1][0] + spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], spans[-1][1] + 1)
                    else:
                        spans.append((at, 1))
        if kind == BOTH:
            self.held.append((words, raw, doc))
        return spans


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Spans that smaller documents hold, from segments and references."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            out = [[], [], [], []]
            cols = (batch.column(c).to_pylist() for c in ("route", "kind", "doc_id", "version", "starts", "words"))
            for route, kind, doc, version, starts, raw in zip(*cols, strict=True):
                if route != at:
                    at, shard = route, Shard()
                for a, n in shard.see(kind, doc, raw):
                    for c, v in zip(out, (doc, version, [x + a for x in starts], n), strict=True):
                        c.append(v)
            if out[0]:
                yield _spans(out)

    ordered = rows.repartition("route").sortWithinPartitions("route", "kind", "doc_id")
    return ordered.mapInArrow(stream, SPAN)


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; with ``with_text``
    also the kept words as ``kept_text``."""
    held = written(read_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))))
    named = held.where(F.col("doc_id").isNotNull())
    # ``own``: the versions of a document that no smaller one has.
    firsts = named.groupBy("version").agg(F.min("doc_id").alias("_first"))
    own = written(
        named.select("doc_id", "version").join(firsts, "version").where("doc_id = _first").groupBy("doc_id").agg(F.collect_set("version").alias("own"))
    )
    # Copies of one text count too; only the first one's segments are sent.
    pairs = named.select("doc_id", F.explode("keys").alias("key"))
    shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    is_hot = F.col("n") > SHARD_DOCS
    per_doc = pairs.select("doc_id", "key").join(shared, "key").groupBy("doc_id").agg(
        F.collect_list(F.when(~is_hot, F.col("key"))).alias("cold"), F.collect_list(F.when(is_hot, F.col("key"))).alias("hot")
    ).join(own, "doc_id")
    row = named.select("doc_id", "version", "packed").join(per_doc, "doc_id").where(F.array_contains("own", F.col("version")))
    streamed = written(segments(row))
    # Windows of hot minimisers that two documents hold; a window of one
    # document alone is no reference.
    hot = streamed.where(F.col("kind") == STREAMED)
    twice = hot.groupBy("route", "words").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("_last"), F.count("*").alias("n")).where("first < _last")
    twice = written(twice.drop("_last"))
    is_heavy = F.col("n") * HEAVY >= hot.count()
    heavy = twice.where(is_heavy)  # at most HEAVY rows: their counts add up to hot.count()
    routes = F.broadcast(heavy.select("route").distinct())
    light = streamed.join(routes, "route", "left_anti")
    refs = twice.where(~is_heavy).join(routes, "route", "left_anti").select(
        "route", F.lit(REFERENCE).alias("kind"), F.col("first").alias("doc_id"), F.lit(None).cast("binary").alias("version"), F.array().cast("array<int>").alias("starts"), "words"
    )
    # A route shared with a heavy window by chance goes through the same
    # automaton, which then has to know its other windows too.
    beside = twice.where(~is_heavy).join(routes, "route", "left_semi")
    spans = repeated_spans(light.select(*refs.columns).unionByName(refs)).unionByName(heavy_spans(hot, heavy.unionByName(beside)))
    per_row = spans.groupBy("doc_id").agg(F.collect_list(F.struct("version", "starts", "windows")).alias("spans")).join(own, "doc_id", "right")

    def finish(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        n_words, n_removed, digest, kept_text = [], [], [], []
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "version", "packed", "spans", "own")), strict=True)
        for doc, version, packed, spans_, own_ in rows:
            joined = unpack.decompress(packed)
            words = joined.split()
            keep = np.ones(len(words), bool)
            if doc is not None and version not in (own_ or []) and len(words) >= WINDOW:
                keep[:] = False  # a smaller document has the same words
            for x in spans_ or []:
                if x["version"] == version:
                    for start in x["starts"]:
                        keep[start : start + x["windows"] + WINDOW - 1] = False
            whole = bool(keep.all())
            left = words if whole else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            kept = joined if whole else b" ".join(left)
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            digest.append(hashlib.sha256(kept).hexdigest())
            kept_text.append(kept.decode() if with_text else None)
        cols = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.string())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    texts = held.select("doc_id", "version", "packed")
    joined = texts.where(F.col("doc_id").isNotNull()).join(per_row, "doc_id", "left").select("doc_id", "version", "packed", "spans", "own")
    every = joined.unionByName(texts.where(F.col("doc_id").isNull()), allowMissingColumns=True)
    out = arrow_map(every, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i : i + {WINDOW - 1}], ' '))) AS g FROM d
), f AS (SELECT g, min(doc_id) AS first_doc FROM x GROUP BY g
), r AS (
  SELECT DISTINCT x.doc_id, unnest(range(i, i + {WINDOW})) AS pos FROM x JOIN f ON f.g = x.g AND f.first_doc < x.doc_id
), p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d
), k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM p ANTI JOIN r ON r.doc_id = p.doc_id AND r.pos = p.pos GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
