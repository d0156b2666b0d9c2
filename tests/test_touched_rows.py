"""Touched commits: rows of the walk that can't be first don't meet changes."""

import random

from blobtrail.operators import history as H

CHANGES = "commit_id long, path string, old_path string, log_ord long"


def _brute(paths, changes):
    best = {}
    for key, root, rank in paths:
        walk, todo = {root: -(1 << 62)}, [root]
        while todo:
            path = todo.pop()
            for _, new, old, at in changes:
                if new == path and old and old != new and at > walk[path] and at < walk.get(old, 1 << 62):
                    walk[old] = at
                    todo.append(old)
        for commit, new, old, at in changes:
            for path in (new, old):
                if path in walk and at > walk[path]:
                    best[key, commit] = min(best.get((key, commit), (9, 0)), (rank, at))
    return best


def test_touched_equal_all_roots(spark):
    rng = random.Random(1)
    names = [f"p{i}" for i in range(6)]
    changes = [(c, rng.choice(names), rng.choice([None, None, *names]), c // 2) for c in range(80)]
    paths = [("k", p, i) for i, p in enumerate(names)] + [("m", p, 5 - i) for i, p in enumerate(names[:4])]
    got = H.commits_touching(spark.createDataFrame(paths, "k string, path string, path_rank int"), spark.createDataFrame(changes, CHANGES), key="k")
    assert {(r.k, r.commit_id): tuple(r.touch_ord) for r in got.collect()} == _brute(paths, changes)


def test_a_change_meets_no_root_that_a_better_one_covers(spark, monkeypatch):
    walk = spark.createDataFrame([("k", "a", r, o) for r, o in ((0, 5), (1, 7), (2, 3), (3, 4), (4, -9))], "k string, path string, path_rank int, from_ord long")
    monkeypatch.setattr(H, "follow_renames", lambda *a: walk)
    changes = spark.createDataFrame([(1, "a", None, 8), (2, "a", None, 4), (3, "a", None, 0)], CHANGES)
    out = H.commits_touching(walk, changes, key="k")
    assert {r.commit_id: r.touch_ord.path_rank for r in out.collect()} == {1: 0, 2: 2, 3: 4}
    assert "_least" in out._jdf.queryExecution().optimizedPlan().toString()
