"""D2 on snapshots: changes derived from whole trees, and renames found.

``tree_changes`` compares the tree of every commit with the tree of each of
its parents, merges included: the null-safe full outer join of both trees on
the path, stated as one aggregation (each side marks what it holds), so every
version is shuffled once and no side is broadcast. ``find_renames`` gives each
removed path of such a comparison at most one added path and the reverse: equal
contents first, then the most similar ones. Its candidates come from the
set-similarity join inside one comparison, so no commit's removed paths are
paired with all its added ones; the assignment is made in rounds of mutually
best pairs, which equals taking the best pair left over and over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.functions.content import decode_ignore, normalize_lf
from blobtrail.functions.tokens import DEFAULT_K
from blobtrail.operators.fingerprint_tables import with_fingerprint
from blobtrail.operators.history import basename
from blobtrail.operators.pairs import set_pairs
from blobtrail.operators.ranking import ordered_rank
from blobtrail.session import written

SIDES = ["commit_id", "parent_id"]
RENAME_SCORE = 0.5


def tree_changes(versions: DataFrame, parents: DataFrame) -> DataFrame:
    """(commit_id, parent_id, path, kind, old_blob, blob_id) with kind add,
    remove or modify, one row per path that differs between a commit and one
    parent; a commit without parents (parent_id null) adds its whole tree.

    ``versions``: (commit_id, path, blob_id), one row per file of each tree;
    a blob may be null, a path isn't repeated within a tree. ``parents``:
    (commit_id, parent_id); a parent without files is an empty tree."""
    edges = parents.select(*SIDES).where("commit_id IS NOT NULL AND parent_id IS NOT NULL").distinct()
    roots = versions.select("commit_id").distinct().join(edges, "commit_id", "left_anti")
    edges = edges.unionByName(roots.withColumn("parent_id", F.lit(None).cast(parents.schema["parent_id"].dataType)))
    v = versions.select("commit_id", "path", "blob_id")
    held = lambda here, there: [F.col("blob_id").alias(here), F.lit(None).cast("string").alias(there), F.lit(True).alias(f"in_{here}"), F.lit(False).alias(f"in_{there}")]
    new = edges.join(v, "commit_id").select(*SIDES, "path", *held("new", "old"))
    old = edges.join(v.withColumnRenamed("commit_id", "parent_id"), "parent_id").select(*SIDES, "path", *held("old", "new"))
    both = new.unionByName(old).groupBy(*SIDES, "path").agg(F.max("new").alias("new"), F.max("old").alias("old"), F.max("in_new").alias("in_new"), F.max("in_old").alias("in_old"))
    kind = F.when(~F.col("in_old"), "add").when(~F.col("in_new"), "remove").otherwise("modify")
    differs = both.where(~(F.col("in_new") & F.col("in_old") & F.col("new").eqNullSafe(F.col("old"))))
    return differs.select(*SIDES, "path", kind.alias("kind"), F.col("old").alias("old_blob"), F.col("new").alias("blob_id"))


def _paired(removed: DataFrame, added: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Pairs the k-th removed with the k-th added path of equal keys; ranks
    come from range partitions, so a group of many copies isn't one task."""
    r = ordered_rank(removed, keys, [F.col("old_path")], "_k").select(*keys, "_k", "old_path")
    a = ordered_rank(added, keys, [F.col("path")], "_k").select(*keys, "_k", "path")
    return r.join(a, [*keys, "_k"]).select("edge", "old_path", "path", F.col("blob_id").alias("old_blob"), "blob_id", F.lit(1.0).alias("score"), F.lit(how).alias("how"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """One-to-one choice from ``pairs`` (edge, old_path, path, score): the best
    pair of an edge, then the best of what is left, and so on; better is the
    higher score, then the smaller old path, then the smaller path. Each round
    takes all pairs that are the best one of both their paths."""
    left = written(pairs.select("edge", "old_path", "path", "score").withColumn("o", F.struct((-F.col("score")).alias("s"), "old_path", "path")))
    chosen = None
    while not left.isEmpty():
        by_old = left.groupBy("edge", "old_path").agg(F.min("o").alias("o")).select("edge", "o")
        by_new = left.groupBy("edge", "path").agg(F.min("o").alias("o")).select("edge", "o")
        taken = written(by_old.join(by_new, ["edge", "o"]).select("edge", "o.old_path", "o.path", (-F.col("o.s")).alias("score")))
        chosen = taken if chosen is None else chosen.unionByName(taken)
        left = written(left.join(taken.select("edge", "old_path"), ["edge", "old_path"], "left_anti").join(taken.select("edge", "path"), ["edge", "path"], "left_anti"))
    return left.select("edge", "old_path", "path", "score") if chosen is None else chosen


def find_renames(diff: DataFrame, contents: DataFrame, threshold: float = RENAME_SCORE, shingle_size: int = DEFAULT_K) -> DataFrame:
    """(commit_id, parent_id, old_path, path, old_blob, blob_id, score, how):
    added paths that continue a removed one. how is ``same_name`` (equal blob
    and base name), ``same_blob`` or ``similar`` (shingle Jaccard >= threshold).

    ``diff``: as ``tree_changes`` gives it. ``contents``: (blob_id, content)."""
    edge = F.struct(*SIDES)
    diff = diff.select(F.to_json(edge).alias("edge"), *SIDES, "path", "kind", "old_blob", "blob_id")
    removed = written(diff.where("kind = 'remove'").select("edge", F.col("path").alias("old_path"), F.col("old_blob").alias("blob_id"), basename(F.col("path")).alias("name")))
    added = written(diff.where("kind = 'add'").select("edge", "path", "blob_id", basename(F.col("path")).alias("name")))
    found = []
    for how, keys in (("same_name", ["edge", "blob_id", "name"]), ("same_blob", ["edge", "blob_id"])):
        found.append(written(_paired(removed, added, keys, how)))
        removed = written(removed.join(found[-1].select("edge", "old_path"), ["edge", "old_path"], "left_anti"))
        added = written(added.join(found[-1].select("edge", "path"), ["edge", "path"], "left_anti"))
    # Only comparisons that still have both, and each of their contents once.
    removed = removed.join(added.select("edge").distinct(), "edge", "left_semi")
    added = added.join(removed.select("edge").distinct(), "edge", "left_semi")
    kind = contents.schema["content"].dataType
    wanted = removed.select("blob_id").unionByName(added.select("blob_id")).distinct()
    texts = contents.select("blob_id", "content").dropDuplicates(["blob_id"]).join(wanted, "blob_id", "left_semi")
    texts = texts.select("blob_id", decode_ignore(normalize_lf(F.col("content"), kind), kind).alias("text"))
    sets = with_fingerprint(texts, "text", "jaccard", k=shingle_size).select("blob_id", "fp")
    # One table of both sides, as the join reads them several times and each time
    # would move all sets.
    rows = lambda df, path, old: df.select("blob_id", "edge", F.col(path).alias("key"), F.lit(old).alias("old"))
    held = written(rows(removed, "old_path", True).unionByName(rows(added, "path", False)).join(sets, "blob_id").select("edge", "key", "old", "fp"))
    scored = set_pairs(held.where("old").drop("old"), held.where("NOT old").drop("old"), threshold, items="fp", block="edge")
    similar = best_pairs(scored.select("edge", F.col("l_key").alias("old_path"), F.col("r_key").alias("path"), "score"))
    similar = similar.join(removed.select("edge", "old_path", F.col("blob_id").alias("old_blob")), ["edge", "old_path"]).join(added.select("edge", "path", "blob_id"), ["edge", "path"])
    every = similar.withColumn("how", F.lit("similar"))
    for part in found:
        every = every.unionByName(part)
    # The sides of each comparison come back from the diff itself.
    at = diff.where("kind = 'add'").select("edge", "path", *SIDES)
    return every.join(at, ["edge", "path"]).select(*SIDES, "old_path", "path", "old_blob", "blob_id", "score", "how")


def as_changes(diff: DataFrame, renames: DataFrame, log: DataFrame) -> DataFrame:
    """The table of changes that path and blob lookups read: (commit_id, path,
    old_path, blob_id, kind, log_ord). A modification is a remove and an add; a
    rename is an add that names its old path, and the old path's remove.
    ``log``: (commit_id, log_ord)."""
    moved = renames.select(*SIDES, "path", "old_path")
    keys = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*SIDES, "path"]]
    adds = diff.where("kind <> 'remove'").alias("d").join(moved.alias("m"), keys, "left").select("d.commit_id", "d.path", "m.old_path", "d.blob_id", F.lit("add").alias("kind"))
    removes = diff.where("kind <> 'add'").select("commit_id", "path", F.lit(None).cast("string").alias("old_path"), F.col("old_blob").alias("blob_id"), F.lit("remove").alias("kind"))
    return adds.unionByName(removes).distinct().join(log.select("commit_id", "log_ord"), "commit_id")
