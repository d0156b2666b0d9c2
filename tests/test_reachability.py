import random

import pytest
from pyspark.sql import functions as F

from blobtrail.operators import history as H
from blobtrail.operators import reachability as R


def merge_heavy(seed, n, merges):
    """A random history: each commit continues an earlier one, and most merge
    up to ``merges`` more."""
    rng = random.Random(seed)
    edges = []
    for c in range(1, n):
        first = rng.randrange(max(0, c - 6), c)
        others = {rng.randrange(max(0, c - 40), c) for _ in range(rng.randrange(merges + 1))} - {first}
        edges += [(c, first, 0)] + [(c, p, k + 1) for k, p in enumerate(sorted(others))]
    return edges


def ancestors(edges, tip):
    up = {}
    for c, p, _ in edges:
        up.setdefault(c, []).append(p)
    seen, todo = {tip}, [tip]
    while todo:
        for p in up.get(todo.pop(), []):
            if p not in seen:
                seen.add(p)
                todo.append(p)
    return seen


@pytest.mark.parametrize("seed,n,merges", [(1, 400, 3), (2, 250, 0), (3, 120, 6)])
def test_labels_against_graph_search(spark, seed, n, merges):
    edges = merge_heavy(seed, n, merges)
    rng = random.Random(seed)
    tips = {f"origin/{name}": rng.randrange(n // 2, n) for name in ("main", "x", "y", "pr/3/head", "z", "2.1")} | {"origin/root": 0}
    parents = spark.createDataFrame(edges, "commit_id long, parent_id long, ord int")
    refs = spark.createDataFrame([*tips.items(), ("origin/gone", None)], "branch string, tip_commit long")
    cover = R.chain_cover(parents.select("commit_id"), parents, order="ord").cache()
    rows = cover.collect()
    assert len(rows) == len({(r.chain, r.pos) for r in rows}) == n
    labels = R.branch_labels(refs, cover, parents)
    want = {(b, c) for b, tip in tips.items() for c in ancestors(edges, tip)}
    assert {tuple(r) for r in R.contained(labels, cover).collect()} == want
    assert {r.branch: r.n_commits for r in R.reach_sizes(labels).collect()} == {b: len(ancestors(edges, t)) for b, t in tips.items()}
    # The label is small: no more rows than chains a branch, far below commits.
    assert labels.count() <= len(tips) * len({r.chain for r in rows})
    relation = spark.createDataFrame(sorted(want), "branch string, commit_id long")
    by_list = {r.commit_id: (r.is_priority, r.branch) for r in H.commit_branch_info(relation).collect()}
    by_label = {r.commit_id: (r.is_priority, r.branch) for r in H.labelled_branch_info(cover, labels).collect()}
    assert by_label == by_list
    some = spark.createDataFrame([(c,) for c in (0, 3, n - 1)], "commit_id long")
    assert H.labelled_branch_lists(cover, labels, some).orderBy("commit_id").collect() == H.branch_lists(relation, some).orderBy("commit_id").collect()


def test_long_chain_and_empty_graph(spark):
    n = 3000
    parents = spark.range(1, n).select(F.col("id").alias("commit_id"), (F.col("id") - 1).alias("parent_id"))
    refs = spark.createDataFrame([("b", n - 1), ("c", 10), ("lone", n + 5)], "branch string, tip_commit long")
    cover, labels = H.reach_labels(refs, parents)
    assert sorted(tuple(r) for r in labels.collect()) == [("b", 0, n - 1), ("c", 0, 10), ("lone", n + 5, 0)]
    none = spark.createDataFrame([], "commit_id long, parent_id long")
    assert H.branches_containing(refs.where("branch = 'none'"), none).count() == 0
