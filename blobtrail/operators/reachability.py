"""H1 reachability by a chain cover of the commit graph.

Commits are split into vertex-disjoint chains along first-parent edges (a
commit goes on in the chain of its first parent when it is that parent's
chosen child). A commit is then (chain, pos), pos counted from the root end,
so new commits never renumber old ones. What a commit reaches on a chain is
everything up to some position; a branch is labelled with the furthest
position its tip reaches on each chain, and containment is the range test
``pos <= label.pos``. No table of pairs at 2^k steps is built: a label has one
row per (branch, chain), the cover one row per commit.

Chains are ranked by pointer doubling over one successor per commit; labels
grow over the edges between chains, dominated ones left out, in as many rounds
as the longest needed sequence of chains. Every round is written to the shared
folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blobtrail.session import written


def chain_cover(commits: DataFrame, parents: DataFrame, order: str | None = None) -> DataFrame:
    """(commit_id, chain, pos) of every commit; ``chain`` is named by its
    root-most commit. ``parents``: (commit_id, parent_id) and, where given,
    the column ``order`` that puts a commit's parents in order; without it the
    smallest parent counts as the first."""
    edges = parents.select("commit_id", "parent_id", (F.col(order) if order else F.col("parent_id")).alias("_o")).where("commit_id <> parent_id")
    first = edges.groupBy("commit_id").agg(F.min(F.struct("_o", "parent_id")).getField("parent_id").alias("parent_id"))
    chosen = first.groupBy("parent_id").agg(F.min("commit_id").alias("commit_id"))
    every = commits.select("commit_id").unionByName(parents.select("commit_id")).unionByName(parents.select(F.col("parent_id").alias("commit_id"))).distinct()
    start = every.join(chosen, "commit_id", "left")
    # anc: the chain's commit ``dist`` steps towards its root; settled once
    # that one has no successor.
    state = written(start.select("commit_id", F.coalesce("parent_id", "commit_id").alias("anc"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("parent_id").isNull().alias("settled")))
    while True:
        open_ = state.where(~F.col("settled"))
        if open_.isEmpty():
            return state.select("commit_id", F.col("anc").alias("chain"), F.col("dist").alias("pos"))
        ahead = state.select(F.col("commit_id").alias("anc"), F.col("anc").alias("_anc"), F.col("dist").alias("_dist"), F.col("settled").alias("_settled"))
        moved = open_.join(ahead, "anc").select("commit_id", F.col("_anc").alias("anc"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_settled").alias("settled"))
        state = written(state.where("settled").unionByName(moved))


def cross_edges(cover: DataFrame, parents: DataFrame) -> DataFrame:
    """(chain, pos, to_chain, to_pos): parent edges between chains. Of two
    edges between the same chains, one that starts further from the root and
    leads no further is dominated and left out."""
    side = lambda commit, chain, pos: cover.select(F.col("commit_id").alias(commit), F.col("chain").alias(chain), F.col("pos").alias(pos))
    e = parents.select("commit_id", "parent_id").join(side("commit_id", "chain", "pos"), "commit_id").join(side("parent_id", "to_chain", "to_pos"), "parent_id")
    e = e.where("chain <> to_chain").groupBy("chain", "pos", "to_chain").agg(F.max("to_pos").alias("to_pos"))
    before = Window.partitionBy("chain", "to_chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("_best", F.max("to_pos").over(before)).where("_best IS NULL OR _best < to_pos").drop("_best")


def branch_labels(refs: DataFrame, cover: DataFrame, parents: DataFrame) -> DataFrame:
    """(branch, chain, pos): the furthest position on each chain that the
    branch's tip reaches. Tips that are no known commit give no row."""
    edges = written(cross_edges(cover, parents))
    tips = refs.select("branch", F.col("tip_commit").alias("commit_id")).join(cover, "commit_id")
    labels = written(tips.groupBy("branch", "chain").agg(F.max("pos").alias("pos")))
    fresh = labels.withColumn("was", F.lit(-1).cast("long"))
    while True:
        # Edges up to ``was`` have been taken in an earlier round.
        e = edges.withColumnsRenamed({"chain": "_chain", "pos": "_pos"})
        step = fresh.join(e, (F.col("chain") == F.col("_chain")) & (F.col("_pos") <= F.col("pos")) & (F.col("_pos") > F.col("was")))
        reached = step.groupBy("branch", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("pos"))
        known = labels.select("branch", "chain", F.col("pos").alias("was"))
        fresh = written(reached.join(known, ["branch", "chain"], "left").where("was IS NULL OR was < pos").withColumn("was", F.coalesce("was", F.lit(-1).cast("long"))))
        if fresh.isEmpty():
            return labels
        labels = written(labels.unionByName(fresh.drop("was")).groupBy("branch", "chain").agg(F.max("pos").alias("pos")))


def contained(labels: DataFrame, cover: DataFrame) -> DataFrame:
    """(branch, commit_id) of every commit that a branch holds."""
    at = cover.select("commit_id", F.col("chain").alias("_chain"), F.col("pos").alias("_pos"))
    return labels.join(at, (F.col("chain") == F.col("_chain")) & (F.col("_pos") <= F.col("pos"))).select("branch", "commit_id")


def reach_sizes(labels: DataFrame) -> DataFrame:
    """(branch, n_commits) from the labels alone."""
    return labels.groupBy("branch").agg(F.sum(F.col("pos") + 1).alias("n_commits"))


def least_branch(labels: DataFrame, cover: DataFrame, rank: Column) -> DataFrame:
    """Per commit that some branch holds, the least (rank, branch) of its
    branches, without listing them: on a chain, the least one of the branches
    that reach a position or beyond is a step function with few steps."""
    tipward = Window.partitionBy("chain").orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, 0)
    run = labels.select("chain", "pos", F.struct(rank.alias("rank"), "branch").alias("b")).withColumn("best", F.min("b").over(tipward))
    steps = run.groupBy("chain", "best").agg(F.max("pos").alias("upto"))
    down = Window.partitionBy("chain").orderBy(F.col("upto").desc())
    steps = steps.withColumn("beyond", F.coalesce(F.lead("upto").over(down), F.lit(-1).cast("long")))
    at = cover.select("commit_id", F.col("chain").alias("_chain"), "pos")
    j = at.join(steps, (F.col("chain") == F.col("_chain")) & (F.col("pos") <= F.col("upto")) & (F.col("pos") > F.col("beyond")))
    return j.select("commit_id", "best.rank", "best.branch")
