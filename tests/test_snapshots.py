import itertools
import random
from collections import defaultdict

import bruteforce as BF
from blobtrail.functions.content import blob_id
from blobtrail.operators import history as H
from blobtrail.operators import snapshots as SN
from pyspark.sql import functions as F

VERSIONS = "commit_id long, path string, content string"


def versions(spark, rows):
    return spark.createDataFrame(rows, VERSIONS).withColumn("blob_id", blob_id(F.col("content")))


def test_tree_changes_of_merges_roots_and_empty_trees(spark):
    rows = [
        (1, "a", "x"), (1, "b", "y"),
        (2, "a", "x2"), (2, "b", "y"),            # modifies a
        (3, "b", "y"), (3, "c", "z"),             # removes a, adds c
        (4, "a", "x2"), (4, "b", "y"), (4, "c", "z"),  # merge of 2 and 3
        (6, "a", "x"),                            # child of 5, which has no files
        (7, "only", "root"),
    ]
    parents = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3), (4, 3), (5, 4), (6, 5)], "commit_id long, parent_id long")
    v = versions(spark, rows)
    got = sorted((r.commit_id, r.parent_id or 0, r.path, r.kind) for r in SN.tree_changes(v, parents).collect())
    assert got == sorted([
        (1, 0, "a", "add"), (1, 0, "b", "add"), (2, 1, "a", "modify"), (3, 1, "a", "remove"), (3, 1, "c", "add"), (4, 2, "c", "add"), (4, 3, "a", "add"),
        (5, 4, "a", "remove"), (5, 4, "b", "remove"), (5, 4, "c", "remove"), (6, 5, "a", "add"), (7, 0, "only", "add"),
    ])
    assert SN.tree_changes(v.limit(0), parents.limit(0)).count() == 0
    # A null blob differs from any other, and from no null.
    nulls = spark.createDataFrame([(1, "p", None), (1, "q", None), (2, "p", "b"), (2, "q", None)], "commit_id long, path string, blob_id string")
    got = [(r.path, r.kind, r.old_blob, r.blob_id) for r in SN.tree_changes(nulls, spark.createDataFrame([(2, 1)], "commit_id long, parent_id long")).collect() if r.commit_id == 2]
    assert got == [("p", "modify", None, "b")]


def brute_renames(old, new, k, threshold):
    """One comparison by loops: {path: content} to {path: content}."""
    removed, added = {p: c for p, c in old.items() if p not in new}, {p: c for p, c in new.items() if p not in old}
    out = []

    def take(same):
        for p in sorted(removed):
            for q in sorted(added):
                if p in removed and q in added and same(p, q):
                    out.append((p, q))
                    del removed[p], added[q]

    base = lambda p: p.rsplit("/", 1)[-1]
    take(lambda p, q: removed[p] == added[q] and base(p) == base(q))
    take(lambda p, q: removed[p] == added[q])
    score = lambda p, q: BF.jaccard(set(BF.shingles(BF.tokens(removed[p]), k)), set(BF.shingles(BF.tokens(added[q]), k)))
    for s, p, q in sorted((-score(p, q), p, q) for p in removed for q in added):
        if -s >= threshold and p in removed and q in added:
            out.append((p, q))
            del removed[p], added[q]
    return out


def test_renames_against_loops_with_ties(spark):
    rng = random.Random(2)
    bodies = [" ".join(f"w{rng.randrange(60)}" for _ in range(30)) for _ in range(4)]

    def text():
        words = rng.choice(bodies).split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(30)] = f"n{rng.randrange(9)}"
        return " ".join(words)

    rows, want, parents = [], set(), []
    for edge in range(25):
        old = {f"{rng.choice('ab')}/f{rng.randrange(6)}": text() for _ in range(6)}
        new = {f"{rng.choice('bcd')}/f{rng.randrange(6)}": text() for _ in range(6)}
        new |= {f"e/{p[2:]}{rng.choice(['', 'x'])}": c for p, c in old.items() if rng.random() < 0.6}
        parents.append((2 * edge + 1, 2 * edge))
        rows += [(2 * edge, p, c) for p, c in old.items()] + [(2 * edge + 1, p, c) for p, c in new.items()]
        want |= {(2 * edge + 1, p, q) for p, q in brute_renames(old, new, 2, 0.4)}
    v = versions(spark, rows)
    diff = SN.tree_changes(v, spark.createDataFrame(parents, "commit_id long, parent_id long"))
    found = SN.find_renames(diff, v, threshold=0.4, shingle_size=2).collect()
    assert {(r.commit_id, r.old_path, r.path) for r in found} == want and len(found) == len(want)
    assert {r.how for r in found} == {"same_name", "same_blob", "similar"}


def test_best_pairs_take_the_best_left_over_and_over(spark):
    rng = random.Random(7)
    pairs = [(e, f"o{rng.randrange(8)}", f"n{rng.randrange(8)}", rng.randrange(4) / 4) for e in ("x", "y", "z") for _ in range(40)]
    pairs = [(*k, s) for k, s in {p[:3]: p[3] for p in pairs}.items()]
    used, want = defaultdict(set), set()
    for e, o, n, s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if ("o", o) not in used[e] and ("n", n) not in used[e]:
            used[e] |= {("o", o), ("n", n)}
            want.add((e, o, n, s))
    df = spark.createDataFrame(pairs, "edge string, old_path string, path string, score double")
    assert {tuple(r) for r in SN.best_pairs(df).collect()} == want
    assert SN.best_pairs(df.limit(0)).count() == 0


def test_touching_follows_renames_that_were_found(spark):
    body = " ".join(f"line{i}" for i in range(40))
    rows = [(1, "old.txt", body), (2, "new.txt", body + " more"), (3, "new.txt", body + " more and more")]
    v = versions(spark, rows)
    parents = spark.createDataFrame([(2, 1), (3, 2)], "commit_id long, parent_id long")
    diff = SN.tree_changes(v, parents)
    log = spark.createDataFrame([(c, -c) for c in (1, 2, 3)], "commit_id long, log_ord long")
    changes = SN.as_changes(diff, SN.find_renames(diff, v), log)
    paths = spark.createDataFrame([("k", "new.txt", 0)], "k string, path string, path_rank int")
    assert sorted(r.commit_id for r in H.commits_touching(paths, changes, key="k").collect()) == [1, 2, 3]


def test_trees_and_sets_move_each_text_once(spark, tmp_path, monkeypatch):
    from blobtrail.sources.testdata import Repo

    texts = spark.createDataFrame([(k, f"text number {(k or 0) // 2} of the files") for k in [*range(90), 7, 130, None]], "doc_id long, text string")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    trees = Repo(spark, str(tmp_path)).trees()
    plan = trees._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Join LeftSemi" in line)
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    inside = [x for x in itertools.takewhile(lambda x: deep(x) > deep(plan[at]), plan[at + 1 :]) if "Relation" not in x]
    assert inside and not any("text#" in x for x in inside)
    ids = [*range(90), 7, 130]
    want = [k + 20 * age for k in ids for age in range(4) if k + 20 * age in set(ids) for _ in range(2 if k % 5 == 0 else 1)]
    assert sorted(r.commit_id for r in trees.collect()) == sorted(want)
    seen, plain = [], SN.set_pairs
    monkeypatch.setattr(SN, "set_pairs", lambda l, r, *a, **kw: (seen.extend([l, r]), plain(l, r, *a, **kw))[1])
    v = versions(spark, [(1, "a", "one two three four five six"), (2, "b", "one two three four five seven"), (1, "c", "z")])
    diff = SN.tree_changes(v, spark.createDataFrame([(2, 1)], "commit_id long, parent_id long"))
    assert [(r.old_path, r.path, r.how) for r in SN.find_renames(diff, v, 0.3, 3).collect()] == [("a", "b", "similar")]
    assert seen and not any("Join" in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)
