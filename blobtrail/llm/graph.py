"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.llm.common import written


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): one row (v, m) for each node v that isn't the
    smallest of its component, with that smallest node m. Every round hooks
    each node's neighbours to its smallest neighbour, larger ones first, then
    smaller ones; the table never outgrows the edges, each round is written
    out, and the number of rounds is logarithmic in practice. Minima are
    taken by partial aggregation; a hub's rows are split by the join."""
    ends = edges.where("a <> b")
    stars = written(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    before = _state(stars)
    while True:
        both = stars.select(F.col("v").alias("u"), F.col("m").alias("w")).unionByName(stars.select(F.col("m").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("_w")).select("u", F.least("u", "_w").alias("m"))
        large = written(both.join(least, "u").where("w > u").select(F.col("w").alias("v"), "m").distinct())
        low = large.groupBy("v").agg(F.min("m").alias("_m"))
        hooked = large.join(low, "v").where("m <> _m").select(F.col("m").alias("v"), F.col("_m").alias("m"))
        stars = written(hooked.unionByName(low.select("v", F.col("_m").alias("m"))).distinct())
        now = _state(stars)
        if now == before:
            return stars
        before = now
