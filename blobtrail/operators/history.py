"""History operators over the commit graph and path tables:
C1 path discovery, C2 candidate paths, C3 blob id validity, D2/D3 touched
commits, H1 branches containing a commit, H2 timestamps, A2 content of a path
at a commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blobtrail.operators import reachability as R
from blobtrail.session import written


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def valid_blob_id(blob: Column) -> Column:
    """Keep a blob id only when it is 40 characters long, else null."""
    return F.when(F.length(blob) == 40, blob)


def discover_paths(names: DataFrame, path_objects: DataFrame, name_col: str = "name") -> DataFrame:
    """For each wanted base name, the distinct known paths with that base
    name, with their first-seen order ``path_ord``.

    ``names``: (``name_col``, ...) rows, e.g. one per query; deduplicated
    here so a popular name is joined once. ``path_objects``: (path, ord)."""
    paths = (
        path_objects.where(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.min("ord").alias("path_ord"))
        .withColumn("name", basename(F.col("path")))
    )
    wanted = names.select(F.col(name_col).alias("name")).distinct()
    return wanted.join(paths, "name")


def candidate_paths(
    queries: DataFrame, path_objects: DataFrame, hint_col: str | None = None, name_col: str = "path"
) -> DataFrame:
    """Per query, the hint path first (rank 0), then the discovered paths
    whose base name equals the query's file name (or the hint's when the
    query has none), deduplicated with the smallest rank kept.

    Output: (query_id, path, path_rank) with path_rank a sortable struct."""
    q = queries.select(
        "query_id",
        (F.col(hint_col) if hint_col else F.lit(None).cast("string")).alias("hint"),
        F.col(name_col).alias("qpath"),
    )
    q = q.withColumn(
        "name",
        F.coalesce(F.nullif(basename(F.col("qpath")), F.lit("")), F.nullif(basename(F.col("hint")), F.lit(""))),
    )
    found = discover_paths(q, path_objects, "name")
    disc = q.join(found, "name").select(
        "query_id", "path", F.struct(F.lit(1).alias("tier"), F.col("path_ord").alias("ord")).alias("path_rank")
    )
    hint = q.where(F.col("hint").isNotNull() & (F.col("hint") != "")).select(
        "query_id", F.col("hint").alias("path"), F.struct(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("ord")).alias("path_rank")
    )
    return hint.unionByName(disc).groupBy("query_id", "path").agg(F.min("path_rank").alias("path_rank"))


def follow_renames(paths: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The candidate paths and, transitively, the paths they were renamed
    from: (key, path, path_rank, from_ord). An earlier path counts only for
    commits older than its rename (``log_ord`` above ``from_ord``; the log is
    newest first). One round per rename in a chain, each written."""
    renames = written(
        changes.where(F.col("old_path").isNotNull() & (F.col("old_path") != F.col("path"))).select("path", "old_path", F.col("log_ord").alias("at"))
    )
    cols = [key, "path", "path_rank"]
    known = written(paths.select(*cols, F.lit(-(1 << 62)).cast("long").alias("from_ord")))
    fresh = known
    while True:
        step = (
            fresh.join(renames, "path").where("at > from_ord")
            .groupBy(key, F.col("old_path").alias("path"), "path_rank").agg(F.min("at").cast("long").alias("from_ord"))
        )
        seen = known.select(*cols, F.col("from_ord").alias("_seen"))
        fresh = written(step.join(seen, cols, "left").where("_seen IS NULL OR _seen > from_ord").drop("_seen"))
        if fresh.isEmpty():
            return known
        known = written(known.unionByName(fresh).groupBy(*cols).agg(F.min("from_ord").alias("from_ord")))


def commits_touching(paths: DataFrame, changes: DataFrame, key: str = "query_id", renames: bool = True) -> DataFrame:
    """D2+D3: commits that changed any of a key's candidate paths (or renamed
    it away) and, following renames, its earlier paths before their rename;
    first occurrence kept in (path_rank, log_ord) order.

    ``paths``: (key, path, path_rank). Output: (key, commit_id, touch_ord)."""
    walk = follow_renames(paths, changes, key) if renames else paths.withColumn("from_ord", F.lit(-(1 << 62)).cast("long"))
    by_path = changes.select("commit_id", "path", "log_ord").unionByName(
        changes.where(F.col("old_path").isNotNull()).select("commit_id", F.col("old_path").alias("path"), "log_ord")
    )
    # Of a key's rows of one path only those count that reach further back than
    # all of smaller rank: the others' commits come first by these.
    better = Window.partitionBy(key, "path").orderBy("path_rank").rowsBetween(Window.unboundedPreceding, -1)
    walk = walk.withColumn("_least", F.min("from_ord").over(better)).where("_least IS NULL OR from_ord < _least").drop("_least")
    touched = walk.join(by_path, "path").where("log_ord > from_ord").select(
        key, "commit_id", F.struct("path_rank", "log_ord").alias("touch_ord")
    )
    return touched.groupBy(key, "commit_id").agg(F.min("touch_ord").alias("touch_ord"))


def first_versions_at(at: DataFrame, key: str = "name") -> DataFrame:
    """Of the versions of candidate paths at touched commits, the one of
    the first path (by path_rank) per (key, commit). Commits where no candidate
    path exists have no row in ``at`` and drop out (the left side of A2's
    null). ``at``: (key, commit_id, path, blob_id, path_rank, touch_ord)."""
    best = at.groupBy(key, "commit_id").agg(F.min(F.struct("path_rank", "path", "blob_id", "touch_ord")).alias("v"))
    return best.select(key, "commit_id", "v.path", "v.blob_id", "v.touch_ord")


def commit_timestamp(commits: DataFrame) -> DataFrame:
    """H2: (commit_id, ts long), 0 when the stored value does not parse."""
    return commits.select("commit_id", F.coalesce(F.expr("try_cast(ts AS BIGINT)"), F.lit(0).cast("long")).alias("ts"))


def branches_containing(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """H1: (branch, commit_id) for every commit reachable from a branch tip,
    by the labels of a chain cover."""
    cover, labels = reach_labels(refs, parents)
    return R.contained(labels, cover)


def reach_labels(refs: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chain cover of the commits that edges or refs name, and the
    branches' labels on it."""
    cover = R.chain_cover(refs.select(F.col("tip_commit").alias("commit_id")), parents)
    return cover, R.branch_labels(refs, cover, parents)


# --- fixed values (branch classes of the reference's selection rules) -------
PRIORITY_BRANCH = r"origin/(trunk|main|master|release|[0-9]+\.[0-9]+)"
PR_BRANCH = r"origin/(pr-|pr/)[0-9]+/(head|merge)?"
# ---------------------------------------------------------------------------


def branch_class(branch: Column) -> Column:
    """0 = priority branch, 1 = PR-like, 2 = other (searches are unanchored)."""
    return F.when(branch.rlike(PRIORITY_BRANCH), 0).when(branch.rlike(PR_BRANCH), 1).otherwise(2)


def commit_branch_info(reach: DataFrame) -> DataFrame:
    """Per commit: is_priority (on any priority branch) and the F4
    representative branch, from a relation (branch, commit_id). Both are
    partial aggregations; no branch list."""
    r = reach.withColumn("cls", branch_class(F.col("branch")))
    return r.groupBy("commit_id").agg(
        F.max(F.col("cls") == 0).alias("is_priority"),
        F.min(F.struct("cls", "branch")).getField("branch").alias("branch"),
    )


def labelled_branch_info(cover: DataFrame, labels: DataFrame) -> DataFrame:
    """The same from a chain cover and its labels, without the relation."""
    best = R.least_branch(labels, cover, branch_class(F.col("branch")))
    return best.select("commit_id", (F.col("rank") == 0).alias("is_priority"), "branch")


def branch_lists(reach: DataFrame, commits: DataFrame) -> DataFrame:
    """(commit_id, branches) sorted, for the commits asked for only (at most
    one entry per ref)."""
    wanted = commits.select("commit_id").distinct()
    return reach.join(wanted, "commit_id").groupBy("commit_id").agg(F.array_sort(F.collect_list("branch")).alias("branches"))


def labelled_branch_lists(cover: DataFrame, labels: DataFrame, commits: DataFrame) -> DataFrame:
    """The same from a chain cover and its labels."""
    return branch_lists(R.contained(labels, cover.join(commits.select("commit_id"), "commit_id", "left_semi")), commits)
