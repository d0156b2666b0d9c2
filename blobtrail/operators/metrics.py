"""E9 step metrics over a step-event table, E8 match counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.functions.text_format import format_ts_ms, humanize_ms


def step_metrics(events: DataFrame) -> DataFrame:
    """E9. ``events``: (run_id, step, start_ts, end_ts). Per (run, step):
    first start, last end, summed milliseconds; plus one ``total`` row per
    run whose milliseconds are the sum of its steps (not wall time), as the
    reference reports. One rollup (partial aggregation) computes both."""
    ms = ((F.unix_micros("end_ts") - F.unix_micros("start_ts")) / 1000).cast("long")
    agg = (
        events.withColumn("ms", ms)
        .rollup("run_id", "step")
        .agg(
            F.min("start_ts").alias("start_ts"),
            F.max("end_ts").alias("end_ts"),
            F.sum("ms").alias("ms"),
            F.grouping("step").alias("is_total"),
            F.grouping("run_id").alias("_all_runs"),
        )
        .where("_all_runs = 0")  # a null run_id is a run of its own
    )
    return agg.select(
        "run_id",
        F.when(F.col("is_total") == 1, F.lit("total")).otherwise(F.col("step")).alias("step"),
        (F.col("is_total") == 1).alias("is_total"),
        format_ts_ms(F.col("start_ts")).alias("start"),
        format_ts_ms(F.col("end_ts")).alias("end"),
        "ms",
        humanize_ms(F.col("ms")).alias("difference_time"),
    )


def match_counters(summary: DataFrame) -> DataFrame:
    """Per mode, the number of queries, with a preferred commit, and the
    summed candidate counts (fork counters: ``fork_counters``)."""
    return summary.groupBy("mode").agg(
        F.count(F.lit(1)).alias("queries"),
        F.sum("candidates_count").alias("candidates"),
        F.count_if(F.col("preferred").isNotNull()).alias("with_preferred"),
    )


def fork_counters(combined: DataFrame, selected: DataFrame) -> DataFrame:
    """E8 fork side: per target, forks discovered (de-duplicated list) and
    selected (after offset/limit)."""
    disc = combined.groupBy("target").agg(F.count(F.lit(1)).alias("forks_discovered"))
    sel = selected.groupBy("target").agg(F.count(F.lit(1)).alias("forks_selected"))
    return disc.join(sel, "target", "left").select(
        "target", "forks_discovered", F.coalesce("forks_selected", F.lit(0)).alias("forks_selected")
    )
