"""Operator 11: line dedup, in DataFrame functions only.

Every text is split at ``\\n`` and its lines are exploded with their positions.
A line's key is the line without ASCII white space at its ends, A-Z in lower
case; keys of at least ``min_chars`` code points become 128-bit hashes (two
differently seeded 64-bit ones), and only these travel on. A hash that at least
``min_docs`` documents hold goes from all of them but the largest doc_id. The
positions of the lines that go come back to their document, where the kept
runs between them are put together again.

At scale: texts are shuffled once, with their positions; lines travel as fixed
width rows. Distinct documents are counted by (hash, document) first, so a line
of a third of all documents reaches its counter as one partial sum a task.
Hashes that make up a ``HEAVY``-th of all lines or more, at most ``HEAVY`` by
that rule, are broadcast, so the other join has no hot key.

Cases: null and empty texts are one empty line. Rows of one doc_id are one
document, whatever their texts; each loses its own lines, and repeated rows
each come back. A null doc_id takes no part and keeps all. An empty table gives
no rows. A text that loses all lines becomes empty. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import once, table, written

# --- fixed values ----------------------------------------------------------
MIN_CHARS = 40
MIN_DOCS = 5
HEAVY = 10_000
WHITE = " \t\n\x0b\x0c\r"
# ---------------------------------------------------------------------------
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line stripped, A-Z in lower case; ``lower`` does the same on a line
    of ASCII alone, faster."""
    bare = F.trim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, version (hash of the text), pos and the key's hash of every line
    whose key is long enough."""
    each = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = each.where(F.length("line") >= min_chars).select("doc_id", "version", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.length("key") >= min_chars).select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, number of documents and the largest of them, per hash of at
    least ``min_docs`` documents."""
    held = lines.groupBy(*HASH, "doc_id").agg(F.lit(1).alias("_one"))
    return held.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= min_docs)


def dropped(lines: DataFrame, min_docs: int, heavy: int = HEAVY) -> DataFrame:
    """The positions that each (doc_id, version) loses, ascending."""
    total = lines.count()
    found = written(repeated(lines, min_docs))
    is_heavy = F.col("n_docs") * heavy >= total
    hot = F.broadcast(found.where(is_heavy))  # at most ``heavy`` rows: their documents' lines add up to ``total``
    rest = found.where(~is_heavy)
    hits = lines.join(hot, HASH).unionByName(lines.join(hot.select(*HASH), HASH, "left_anti").join(rest, HASH))
    gone = hits.where("doc_id <> last")
    return gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.where("doc_id IS NOT NULL")
    gone = dropped(written(hashed_lines(named, min_chars)), min_docs)
    named = named.withColumn("version", F.xxhash64("text")).join(gone, ["doc_id", "version"], "left").drop("version")
    every = named.unionByName(rows.where("doc_id IS NULL"), allowMissingColumns=True)
    d = once(every, "_lines", F.split("text", "\n"))
    d = once(d, "_gone", F.coalesce("gone", F.array().cast("array<int>")))
    # The kept lines are the runs between the positions that go.
    starts = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda p: p + 1))
    ends = F.concat("_gone", F.array(F.size("_lines")))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice("_lines", a + 1, b - a))
    kept = F.when(F.size("_gone") == 0, F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    return d.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.size("_gone").cast("long").alias("n_dropped"), kept.alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), x AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND c.last_doc <> k.doc_id AS gone FROM k LEFT JOIN c ON c.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
