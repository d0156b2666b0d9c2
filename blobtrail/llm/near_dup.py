"""Operator 2: near-duplicate documents by circulant MinHash.

Documents of one word sequence form a class first (a partial aggregation), so
exact copies never meet in pairs. A class's signature has ``COORDS``
coordinates from two permutations: the first scatters the shingles over a
circle of 2^20 places, the second, read from ``COORDS`` shifted starts, gives
each coordinate its minimum. 160 coordinates make 32 bands of 5 (a pair of
similarity 0.8 shares no band with probability 3e-6); the whole signature, 4
bits a coordinate, estimates similarity before the exact check, which compares
the full shingle sets of every pair whose estimate isn't at least four and a
half standard deviations below the limit.

Only connectivity is asked for, so buckets don't emit all their pairs. Every
class is first compared to one random member of each of its buckets, and the
links found give components. What is left are pairs of different components
that share a bucket: these are compared inside the bucket, in blocks of at
most ``BLOCK`` rows, each pair in its first shared band only, and confirmed on
full sets too. Within a component nothing more needs comparing, so a group of
a third of all rows costs a linear number of comparisons; no partner is ever
dropped.

The shingle length is a parameter: four words in the registered query, five
in the pipeline's stage (the general rule for stages on word shingles).

Cases: null or wordless texts have empty sets and are linked with nothing.
Repeated rows are copies of each other. Nodes are word sequences, not ids, so
rows of one doc_id with different texts are judged one by one; a component is
named by the smallest doc_id of its rows. The stage removes by (doc_id, text):
of a component the smallest doc_id's row stays, of several texts under that id
the one of the smallest digest. A null doc_id takes no part: component_id null,
kept. An empty table gives no rows. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import arrow_map, table, text_bytes, written
from blobtrail.llm.graph import components
from blobtrail.llm.words import ODD, grams, hashes, mixed

# --- fixed values ----------------------------------------------------------
SHINGLE = 4  # words, in the registered query
STAGE_SHINGLE = 5  # words, in the pipeline
PERCENT = 80  # links: 100 * intersection >= PERCENT * union
PLACES_BITS, COORDS, BANDS, ROWS = 20, 512, 32, 5
MIN_ESTIMATE = 0.72
BLOCK = 1024
PART = 1000  # texts looked at together
SEED = 2
# ---------------------------------------------------------------------------
# Of 4-bit coordinates one in 16 agrees by chance.
MIN_AGREE = int((MIN_ESTIMATE * 15 / 16 + 1 / 16) * COORDS)
_PERMUTATIONS: list = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the second one's shifted views."""
    if not _PERMUTATIONS:
        rng = np.random.default_rng(SEED)
        first, second = rng.permutation(1 << PLACES_BITS), rng.permutation(1 << PLACES_BITS).astype(np.uint32)
        circle = np.concatenate([second, second[: COORDS - 1]])
        _PERMUTATIONS.extend([first, np.lib.stride_tricks.sliding_window_view(circle, COORDS)])
    return _PERMUTATIONS[0], _PERMUTATIONS[1]


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct shingles, as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return mixed(hashes([b" ".join(words)]))
    return np.unique(grams(hashes(words), shingle))


def signature(shingles: np.ndarray) -> np.ndarray:
    first, shifted = permutations()
    places = first[(shingles >> np.uint64(64 - PLACES_BITS)).astype(np.int64)]
    out = shifted[places[:2048]].min(axis=0)
    for at in range(2048, len(places), 2048):
        np.minimum(out, shifted[places[at : at + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = mixed(key * ODD + rows[:, i])
    return key.view(np.int64)


def nibbles(sig: np.ndarray) -> bytes:
    four = ((sig * np.uint32(2654435761)) >> np.uint32(28)).astype(np.uint8)
    return (four[0::2] << 4 | four[1::2]).tobytes()


def agreement(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Coordinates on which 4-bit signatures agree."""
    x = one ^ many
    return ((x & 15) == 0).sum(axis=-1) + ((x & 240) == 0).sum(axis=-1)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digest, n, bands, sigs = [], [], [], []
        for text in text_bytes(batch):
            words = text.lower().split()
            shingles = shingle_set(words, shingle)
            digest.append(sequence_digest(b" ".join(words)))
            n.append(len(shingles))
            sig = signature(shingles) if len(shingles) else None
            bands.append(None if sig is None else band_keys(sig))
            sigs.append(None if sig is None else nibbles(sig))
        cols = [pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), *cols], ["doc_id", "version", "digest", "n_shingles", "bands", "sig"])

    def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, PART):  # so that few texts and sets are held at a time
            yield from over(batch.slice(at, PART))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_version(F.col("text")).alias("version"))
    return arrow_map(rows, in_parts, "doc_id long, version long, digest binary, n_shingles long, bands array<long>, sig binary")


def text_version(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def sequence_digest(joined: bytes) -> bytes:
    return hashlib.blake2b(joined, digest_size=16).digest()


def packed_words(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the document's words, and these, compressed for the
    shuffle."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        digests, packed = [], []
        for text in text_bytes(batch):
            joined = b" ".join(text.lower().split())
            digests.append(sequence_digest(joined))
            packed.append(pack.compress(joined))
        cols = [pa.array(digests, pa.binary()), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "digest", "packed"])

    def in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, PART):
            yield from over(batch.slice(at, PART))

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), in_parts, "doc_id long, digest binary, packed binary")


def sized(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""

    def over(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array(agreement(one, two) >= MIN_AGREE))

    side = lambda c: sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    near = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    return arrow_map(j.where(near).select("a", "b", "sig_a", "sig_b"), over, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) that are links by their full shingle sets."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, seen = zstandard.ZstdDecompressor(), OrderedDict()

        def full(node: int, packed: bytes) -> np.ndarray:
            key = (node, len(packed), packed[-8:])
            if key not in seen:
                seen[key] = shingle_set(unpack.decompress(packed).split(), shingle)
                if len(seen) > 256:
                    seen.popitem(last=False)
            return seen[key]

        for batch in batches:
            keep = []
            for a, b, pa_, pb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b")), strict=True):
                x, y = full(a, pa_), full(b, pb)
                keep.append(linked(x, y))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "packed_a", "packed_b").mapInArrow(stream, "a long, b long")


def _cell_links(cell: pd.DataFrame, shingle: int) -> pd.DataFrame:
    """Links between different components inside one cell of a bucket: pairs
    that share no earlier band and may be links are confirmed on their full
    sets right here, so only links leave the task."""
    sig = np.frombuffer(b"".join(cell["sig"]), np.uint8).reshape(len(cell), -1)
    bands, node, comp = np.stack(cell["bands"].to_numpy()), cell["node"].to_numpy(), cell["comp"].to_numpy()
    n, part, key, packed = cell["n_shingles"].to_numpy(), cell["part"].to_numpy(), cell["key"].iloc[0], cell["packed"].to_numpy()
    two_sided = cell["x"].iloc[0] != cell["y"].iloc[0]
    unpack, sets, a, b = zstandard.ZstdDecompressor(), {}, [], []

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_set(unpack.decompress(packed[i]).split(), shingle)
        return sets[i]

    for i in range(len(cell)):
        others = np.arange(i + 1, len(cell))
        ok = comp[others] != comp[i]
        if two_sided:
            ok &= part[others] != part[i]
        others = others[ok]
        others = others[100 * np.minimum(n[others], n[i]) >= PERCENT * np.maximum(n[others], n[i])]
        others = others[agreement(sig[i], sig[others]) >= MIN_AGREE]
        if len(others):
            shared = bands[others] == bands[i]
            others = others[bands[i][shared.argmax(axis=1)] == key]
        for o in others:
            if linked(full(i), full(o)):
                a.append(min(node[i], node[o]))
                b.append(max(node[i], node[o]))
        sets.pop(i, None)
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def cross_links(members: DataFrame, sigs: DataFrame, texts: DataFrame, labels: DataFrame, shingle: int) -> DataFrame:
    """Links between components that meet in a bucket. A large bucket is dealt
    into blocks: those of its most frequent component and those of the rest;
    cells join two blocks, never two of the frequent component."""
    rows = members.join(labels, members["node"] == labels["v"], "left").select("key", "node", F.coalesce("m", "node").alias("comp"))
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    main = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("n_comps"))
    main = main.where("n_comps > 1")
    d = rows.join(main, "key").withColumn("is_main", F.col("comp") == F.col("main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    whole = F.col("n_all") <= BLOCK
    n_rest, n_main = blocks(F.col("n_all") - F.col("n_main")), blocks(F.col("n_main"))
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    part = F.when(whole, 0).when(F.col("is_main"), n_rest + deal(n_main)).otherwise(deal(n_rest))
    d = d.withColumn("part", part).withColumn("n_rest", n_rest).withColumn("n_parts", n_rest + n_main)
    rest_ids = F.sequence(F.lit(0), F.col("n_rest") - 1)
    every = F.sequence(F.lit(0), F.col("n_parts") - 1)
    cell = lambda i: F.struct(F.least(F.col("part"), i).alias("x"), F.greatest(F.col("part"), i).alias("y"))
    cells = F.when(whole, F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))).when(F.col("is_main"), F.transform(rest_ids, cell)).otherwise(F.transform(every, cell))
    d = d.select("key", "node", "comp", "part", F.explode(cells).alias("c")).select("key", "node", "comp", "part", "c.x", "c.y")
    d = d.join(sigs.select("node", "n_shingles", "bands", "sig"), "node").join(texts, "node")
    return d.groupBy("key", "x", "y").applyInPandas(lambda cell: _cell_links(cell, shingle), "a long, b long")


def classes(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, version, digest, n_shingles; reps: digest, node,
    first_id; labels: v, m). A node is one word sequence, first_id its smallest
    doc_id; labels lead from a node to the smallest of its component."""
    rows = written(signatures(docs, shingle))
    named = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = written(
        named.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id())  # fixed by being written
    )
    placed = reps.select("node", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    members = written(placed.join(shared, "key").distinct())
    met = members.select("node").distinct()
    sigs = written(reps.join(met, "node").select("node", "n_shingles", "bands", "sig", F.col("first_id").alias("doc_id"), "digest"))
    texts = packed_words(docs.where(F.col("doc_id").isNotNull())).join(sigs.select("node", "doc_id", "digest"), ["doc_id", "digest"])
    texts = written(texts.select("node", "packed").dropDuplicates(["node", "packed"]))
    centre = members.groupBy("key").agg(F.min_by("node", F.xxhash64("key", "node")).alias("centre"))
    star = members.join(centre, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    links = written(confirmed(sized(star, sigs), texts, shingle))
    labels = components(links)
    more = written(cross_links(members, sigs, texts, labels, shingle))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return rows.select("doc_id", "version", "digest", "n_shingles"), reps.select("digest", "node", "first_id"), labels


def judged(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, version, n_shingles, component_id and ``stays`` of every row;
    one (doc_id, text) of a component stays."""
    rows, reps, labels = classes(docs, shingle)
    ends = labels.unionByName(labels.select(F.col("m").alias("v"), "m").distinct())
    named = reps.join(ends, reps["node"] == ends["v"]).select("digest", "m", F.struct("first_id", "digest").alias("name"))
    least = named.groupBy("m").agg(F.min("name").alias("least"))
    linked_ = named.join(least, "m").select("digest", "least")
    alone = reps.select("digest", F.struct("first_id", "digest").alias("_own"))
    j = rows.join(alone, "digest", "left").join(linked_, "digest", "left").withColumn("least", F.coalesce("least", "_own"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("least.first_id"), F.col("doc_id")))
    first = (F.col("least.digest") == F.col("digest")) & (F.col("least.first_id") == F.col("doc_id"))
    stays = F.when(F.col("doc_id").isNotNull() & F.col("least").isNotNull(), first).otherwise(True)
    return j.select("doc_id", "version", "n_shingles", component.alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return judged(docs, shingle).select("doc_id", "n_shingles", "component_id").withColumn("kept", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each group stays; rows without an id stay."""
    gone = judged(docs, STAGE_SHINGLE).where(~F.col("stays")).select(F.col("doc_id").alias("_gone"), F.col("version").alias("_gone_text")).distinct()
    # Rows meet by (id, text) in one exchange, the text in it once; two hashes
    # stand for the text among the rows of one id.
    version = [text_version(F.col("text")).alias("_version"), F.xxhash64(F.lit(1), F.col("text").cast("string")).alias("_check")]
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"), *version)
    left = row.join(gone, (F.col("_id") == F.col("_gone")) & (F.col("_version") == F.col("_gone_text")), "left_anti")
    named = left.where("_id IS NOT NULL").dropDuplicates(["_id", "_version", "_check"])
    return named.unionByName(left.where("_id IS NULL")).select("_row.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), r AS (
  SELECT doc_id AS v, doc_id AS m FROM documents
  UNION SELECT u.b, r.m FROM r JOIN u ON r.v = u.a
), c AS (SELECT v, min(m) AS m FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d JOIN c ON c.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
