"""Operator 3: mixing sources to target weights by Efraimidis-Spirakis
sampling.

Targets: sources in code point order (null last) get the weights in turn and
share ``share`` times the size of everything; no target exceeds ``MOST_EPOCHS``
times its source's size, and what is cut off is shared again by weight among
the rest until no target is above its limit.

Taking: a source gives whole epochs first (all its documents, as often as
they fit into the target); the rest of the target is a weighted sample without
replacement: each document draws the key -ln(u) / w from its quality weight w
and a keyed hash u of its id, and documents are taken in key order while the
running sum of their sizes stays below what is left (a document counts when
its middle does, so the last one is rounded to nearest). Same input, same
seed: same mix.

A source may hold any share of all rows: its documents are dealt over about
sqrt(n) buckets that follow the key order, bucket sums give every bucket its
offset, and running sums are taken inside buckets. No source meets in one
task, and the number of sources isn't bounded either.

Cases: null text has size 0. The null source is a source of its own. Equal
keys (repeated rows) are ordered by size and text hash and each counted. A
document with a null id draws its key from its text. Empty tables, and tables
without any word, take 0 everywhere. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blobtrail.llm.common import WORD, small, table, written

# --- fixed values ----------------------------------------------------------
WEIGHTS = [3, 1, 2]
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
MAX_BROADCAST_SOURCES = 10_000
# ---------------------------------------------------------------------------


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1.5: half plus the share of unaccented letters."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return F.when(F.length(text) > 0, F.lit(0.5) + letters / F.length(text)).otherwise(F.lit(0.5))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Adds ``pos``, the 0-based place of each source in code point order,
    null last: rows are ranged over partitions, numbered inside each, and the
    few partition counts give the offsets."""
    ranged = written(
        sizes.withColumn("_null", F.col("source").isNull())
        .repartitionByRange("_null", "source")
        .withColumn("_part", F.spark_partition_id())
    )
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy("_null", "source")
    numbered = ranged.withColumn("_at", F.row_number().over(inside)).join(offsets, "_part")
    return numbered.select("source", "source_size", "n_docs", "mean_weight", (F.col("_at") + F.col("_before") - 1).alias("pos"))


def with_targets(sources: DataFrame, weights: list[float], share: float) -> DataFrame:
    """Adds ``target``. Each round is one sum over the sources: those whose
    share at the present level exceeds their limit get the limit, the rest
    divide what remains; limits only ever join, so it ends."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    src = sources.withColumn("_w", weight).withColumn("_cap", (MOST_EPOCHS * F.col("source_size")).cast("double"))
    total = src.agg(F.sum("source_size").alias("s"), F.sum("_w").alias("w")).first()
    budget, level = share * (total["s"] or 0), None
    if budget:
        level, capped = budget / total["w"], -1
        while True:
            over = F.col("_cap") < F.col("_w") * level
            r = src.agg(F.sum(F.when(over, F.col("_cap"))).alias("cap"), F.sum(F.when(over, 0).otherwise(F.col("_w"))).alias("w"), F.count(F.when(over, 1)).alias("n")).first()
            if r["n"] == capped or not r["w"]:
                break
            capped = r["n"]
            level = (budget - (r["cap"] or 0.0)) / r["w"]
    return src.withColumn("target", F.round(F.least("_cap", F.col("_w") * F.lit(level or 0.0)), 6)).drop("_w", "_cap")


def mix(docs: DataFrame, size: Column, weight: Column, weights: list[float] = WEIGHTS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """One row per document of ``docs`` (columns doc_id, source, text):
    doc_id, size, source_size, target, taken, copies and text hash."""
    tie = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    named = F.coalesce(F.col("doc_id").cast("string"), tie)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), named).cast("binary")), 1, 13), 16, 10).cast("long")
    d = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), weight.alias("weight"),
            F.substring(tie, 1, 16).alias("tie"), ((draw + 0.5) / float(2**52)).alias("u"),
        )
    )
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.avg("weight").alias("mean_weight"))
    src = written(with_targets(ranked_sources(sizes), weights, share))
    few = small(src.withColumnRenamed("source", "_source"), MAX_BROADCAST_SOURCES)
    d = d.join(few, d["source"].eqNullSafe(few["_source"])).drop("_source")
    key = -F.log("u") / F.col("weight")
    n_buckets = F.ceil(F.sqrt("n_docs"))
    bucket = F.least(n_buckets - 1, F.floor(n_buckets * (1 - F.exp(-key * F.col("mean_weight")))))
    d = d.withColumn("key", key).withColumn("bucket", bucket)
    sums = d.groupBy("pos", "bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("pos").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pos", "bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("pos", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["pos", "bucket"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    middle = F.col("_offset") + F.col("_inside") + F.col("size") / 2
    copies = (epochs + F.when((rest > 0) & (middle <= rest), 1).otherwise(0)).cast("long")
    return d.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "tie")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return mix(table(spark, sf_dir, "documents"), size_of(text), quality_weight(text)).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: every document comes as often as the mix takes it (0 to 2
    times)."""
    text = F.col("text")
    counts = mix(docs, size_of(text), quality_weight(text)).where("copies > 0")
    # Repeated rows share one id and text: one count each, in any order.
    counts = counts.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.sum("copies").alias("_sum"), F.count("*").alias("_n"))
    tie = F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 16)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), tie.alias("_t"))
    hit = rows.join(counts, rows["_doc"].eqNullSafe(counts["_id"]) & (rows["_t"] == counts["_tie"]))
    times = F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(F.col("_sum") / F.col("_n"))).cast("int"))
    return hit.select("_row", F.explode(times)).select("_row.*")


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN length(text) > 0 THEN 0.5::DOUBLE + length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))::DOUBLE / length(text) ELSE 0.5::DOUBLE END AS w,
    substr(md5(coalesce(text, '')), 1, 16) AS tie,
    (('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source
), c AS (
  SELECT *, {MOST_EPOCHS}.0::DOUBLE * source_size AS cap, list_value(3.0, 1.0, 2.0)[pos % 3 + 1]::DOUBLE AS sw FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / sw, pos) AS rn, coalesce(sum(cap) OVER f, 0) AS caps_before, sum(sw) OVER g AS w_from, {SHARE}::DOUBLE * sum(source_size) OVER () AS budget
  FROM c WINDOW f AS (ORDER BY cap / sw, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (ORDER BY cap / sw, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), l AS (
  SELECT arg_min((budget - caps_before) / w_from, rn) FILTER (WHERE (budget - caps_before) / w_from * sw <= cap) AS level FROM o
), t AS (
  SELECT source, source_size, round(least(cap, sw * level), 6) AS target,
    CASE WHEN source_size > 0 THEN floor(round(least(cap, sw * level), 6) / source_size) ELSE 0 END AS epochs FROM c, l
), k AS (
  SELECT d.*, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  CAST((epochs + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k
"""
