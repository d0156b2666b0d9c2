"""row numbers inside groups without gathering a group into one task.

A window ``row_number() over (partition by g order by o)`` sends every row
of a group to one task; a hot group holding a third of the data would make
that one task sort a third of the data. Here the rows are range-partitioned
on (g, o), so a hot group is split over many tasks; each task numbers its
rows locally; a small table of (group, partition) counts gives every
partition's starting offset per group. The numbered partitions are written
out, so ranks don't depend on a second, possibly different, ranging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blobtrail.session import written


def ordered_rank(df: DataFrame, group_cols: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Adds ``out`` = 1-based position of each row inside its group by
    ``order`` (which must be a total order within the group)."""
    keys = [F.col(c) for c in group_cols]
    sorted_df = written(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )  # both columns are fixed from here on
    # One row per (group, partition): at most #partitions rows per group.
    counts = sorted_df.groupBy(*group_cols, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (
        sorted_df.join(offsets.select(*group_cols, "_pid", "_m0", "_off"), [*group_cols, "_pid"])
        .withColumn(out, F.col("_mid") - F.col("_m0") + F.col("_off") + 1)
        .drop("_pid", "_mid", "_m0", "_off")
    )
