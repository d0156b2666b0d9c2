"""A4 report, A5 env pairs, A6 summary as tables built from the cascade.

Per query there is one head; candidate lists are rows keyed by content group
(with rank), since thousands of queries may share one list. The exact tier's
list is keyed by content alone (name null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtrail.operators.ranking import ordered_rank

# --- fixed values: keys and line formats of the outputs ----------------------
COUNTERS = ["forks_fetched", "forks_discovered", "forks_selected"]
BRANCH_SEP = "\t\n"
# -----------------------------------------------------------------------------


def _kv(key: str, value: Column) -> Column:
    return F.concat(F.lit(f"{key}="), value)


def _with_counters(summary: DataFrame, forks: DataFrame | None) -> DataFrame:
    """Adds the fork counters of each query (query_id, COUNTERS...), 0 where
    no fork was looked at."""
    s = summary.join(forks, "query_id", "left") if forks is not None else summary
    for c in COUNTERS:
        s = s.withColumn(c, (F.coalesce(F.col(c), F.lit(0)) if c in s.columns else F.lit(0)).cast("long"))
    return s


def match_report(summary: DataFrame, forks: DataFrame | None = None) -> DataFrame:
    """A4: the report head per query, as columns and as text lines; its
    candidate lines are ``candidate_lines``. ``local_blob_raw`` only when it
    differs from the LF id."""
    s = _with_counters(summary, forks)
    s = s.withColumn("local_blob_raw", F.when(F.col("local_blob_raw") != F.col("local_blob_norm"), F.col("local_blob_raw")))
    head = F.concat_ws(
        "\n",
        _kv("mode", F.col("mode")),
        _kv("preferred", F.coalesce(F.col("preferred").cast("string"), F.lit(""))),
        _kv("local_blob_norm", F.col("local_blob_norm")),
        F.when(F.col("local_blob_raw").isNotNull(), _kv("local_blob_raw", F.col("local_blob_raw"))),
        *[_kv(c, F.col(c).cast("string")) for c in COUNTERS],
        _kv("candidates_count", F.col("candidates_count").cast("string")),
        F.lit("candidates:"),
    )
    return s.select("query_id", "mode", "preferred", "local_blob_norm", "local_blob_raw", *COUNTERS, "candidates_count", head.alias("report_head"))


def candidate_lines(candidates: DataFrame, ts: DataFrame | None, branches: DataFrame | None) -> DataFrame:
    """One row per candidate of a content group with its rank and
    its line of the report. Without ``ts`` and ``branches`` the fast shape,
    which looks up neither."""
    ranked = ordered_rank(candidates.withColumn("list", F.coalesce("name", F.lit(""))), ["list", "blob_norm", "tier"], [F.col("o"), F.col("commit_id")])
    line = F.concat(F.lit("  - commit="), F.col("commit_id").cast("string"))
    if ts is not None and branches is not None:
        ranked = ranked.join(ts, "commit_id", "left").join(branches, "commit_id", "left")
        line = F.concat(
            line, F.lit(" ts="), F.coalesce("ts", F.lit(0)).cast("string"), F.lit(" branches="), F.coalesce(F.array_join("branches", BRANCH_SEP), F.lit(""))
        )
    return ranked.select("name", "blob_norm", "tier", "rank", "commit_id", line.alias("line"))


def match_env(summary: DataFrame, branch_info: DataFrame, branches: DataFrame, forks: DataFrame | None = None) -> DataFrame:
    """A5: (query_id, key, value) pairs; the branch keys only when the
    preferred commit has a representative branch. CANDIDATE_COMMITS is the
    ranked list of ``candidate_lines``."""
    info = branch_info.select(F.col("commit_id").alias("preferred"), "branch")
    s = _with_counters(summary, forks).join(info, "preferred", "left")
    s = s.join(branches.withColumnRenamed("commit_id", "preferred"), "preferred", "left")
    has_branch = F.col("branch").isNotNull() & (F.col("branch") != "")
    values = {
        "PREFERRED_COMMIT": F.coalesce(F.col("preferred").cast("string"), F.lit("")),
        "MATCH_MODE": F.col("mode"),
        **{c.upper(): F.col(c).cast("string") for c in COUNTERS},
        "PREFERRED_BRANCH": F.when(has_branch, F.col("branch")),
        "PREFERRED_BRANCHES": F.when(has_branch, F.concat(F.lit('"'), F.array_join("branches", BRANCH_SEP), F.lit('"'))),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    out = s.select("query_id", F.explode(pairs).alias("kv")).select("query_id", "kv.key", "kv.value")
    return out.where(F.col("value").isNotNull())


def match_summary(summary: DataFrame) -> DataFrame:
    """The recommended commit per query; its list is ``candidate_lines``."""
    recommended = F.concat(F.lit("Recommended commit: "), F.coalesce(F.col("preferred").cast("string"), F.lit("")))
    return summary.select("query_id", "preferred", "candidates_count", recommended.alias("line"))
