import itertools

from pyspark.sql import functions as F

import bruteforce as BF
from blobtrail.operators import forks as FK
from blobtrail.operators import history as H
from blobtrail.operators.cascade import MatchParams, choose_preferred, match_cascade
from blobtrail.operators.fingerprint_tables import with_fingerprint
from blobtrail.operators.pairs import set_pairs, simhash_pairs
from blobtrail.operators.ranking import ordered_rank


def test_set_pairs_lossless_vs_all_pairs(spark):
    """Prefix-filtered join equals the brute-force all-pairs result."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    texts = {r.key: r.text for r in docs.collect()}
    sets = {k: set(BF.shingles(BF.tokens(t), 3)) for k, t in texts.items()}
    f = with_fingerprint(docs, "text", "jaccard", k=3)
    for t in (0.3, 0.6, 0.92):
        got = {(r.l_key, r.r_key) for r in set_pairs(f, None, t, items="fp").collect()}
        want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if BF.jaccard(sets[a], sets[b]) >= t}
        assert got == want


def test_simhash_pairs_lossless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    f = with_fingerprint(docs, "text", "simhash")
    fps = {r.key: r.fp for r in f.collect()}
    got = {(r.l_key, r.r_key) for r in simhash_pairs(f, None, 0.9).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2)
            if 1 - bin((fps[a] ^ fps[b]) & ((1 << 64) - 1)).count("1") / 64 >= 0.9}
    assert got == want


def test_branches_and_selection(spark):
    refs = spark.createDataFrame([("origin/feature/x", "f2"), ("origin/master", "m2"), ("origin/pr/123/head", "p1")],
                                 "branch string, tip_commit string")
    parents = spark.createDataFrame([("f2", "f1"), ("f1", "c0"), ("m2", "m1"), ("m1", "c0"), ("p1", "f1")],
                                    "commit_id string, parent_id string")
    reach = H.branches_containing(refs, parents)
    got = {(r.branch, r.commit_id) for r in reach.collect()}
    assert ("origin/master", "c0") in got and ("origin/feature/x", "f1") in got and ("origin/master", "f1") not in got
    info = {r.commit_id: r for r in H.commit_branch_info(reach).collect()}
    assert info["c0"].branch == "origin/master"
    assert info["f1"].branch == "origin/pr/123/head"
    assert info["f2"].branch == "origin/feature/x"
    # choose_preferred: priority branch first in order, else newest.
    attrs = spark.createDataFrame([("f2", 30, False), ("f1", 20, False), ("m1", 10, True)], "commit_id string, ts long, is_priority boolean")
    o = F.struct(F.lit(0.0).alias("neg_score"), F.col("ord").cast("long").alias("r1"), F.lit(0).cast("long").alias("r2"), F.lit(0).cast("long").alias("r3"))
    hits = spark.createDataFrame([("g", "f2", 0), ("g", "f1", 1), ("g", "m1", 2), ("h", "f2", 1), ("h", "f1", 0)],
                                 "g string, commit_id string, ord int").select("g", "commit_id", o.alias("o"))
    pref = {r.g: r.preferred for r in choose_preferred(hits, ["g"], attrs).collect()}
    assert pref == {"g": "m1", "h": "f2"}


def test_ordered_rank_matches_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 5000).alias("v"))
    got = {(r.g, r.v): r.rank for r in ordered_rank(df, ["g"], [F.col("v")]).collect()}
    rows = sorted(((r.g, r.v) for r in df.collect()))
    want, last, n = {}, None, 0
    for g, v in rows:
        n = n + 1 if g == last else 1
        last = g
        want[(g, v)] = n
    assert got == want


def test_fork_paging_and_names(spark):
    recs = '[{"full_name": "u1/r", "name": "r", "owner": {"login": "u1"}, "clone_url": "c"}]'
    pages = spark.createDataFrame(
        [("t", "repo", 1, recs), ("t", "repo", 2, "[oops"), ("u", "repo", 1, '{"message": "x"}')],
        "target string, src string, page int, body string")
    forks = FK.read_fork_pages(pages, 10, per_page=1)
    assert [(r.target, r.ordinal) for r in forks.collect()] == [("t", 1)]
    comb = FK.union_forks(forks)
    usable = FK.usable_forks(comb, F.lit("r"))
    existing = spark.createDataFrame([("t", "fork_u1_r")], "target string, remote string")
    names = FK.unique_remote_names(usable, existing)
    assert [r.remote for r in names.collect()] == ["fork_u1_r_1"]


def test_cascade_tiers(spark):
    """Exact beats hash beats fuzzy; own commit excluded; no match kept."""
    fv = spark.createDataFrame([
        (1, "a/x.txt", "alpha beta gamma delta"), (2, "a/x.txt", "alpha beta gamma delta"),
        (3, "b/y.txt", "one two three four\r\n"), (4, "b/y.txt", "one two three four five six seven"),
        (5, "c/z.txt", "unrelated words here"),
    ], "commit_id long, path string, content string").withColumn("blob_id", F.sha1(F.col("content")))
    from blobtrail.functions.content import blob_id
    fv = fv.withColumn("blob_id", blob_id(F.col("content"))).withColumn("log_ord", -F.col("commit_id"))
    changes = fv.select("commit_id", "path", F.lit(None).cast("string").alias("old_path"), "blob_id", F.lit("add").alias("kind"), "log_ord")
    po = fv.select("blob_id", "path", F.col("log_ord").alias("ord"))
    q = spark.createDataFrame([(10, "x.txt", "alpha beta gamma delta", 1), (11, "y.txt", "one two three four\n", None),
                               (12, "z.txt", "nothing in common", None)],
                              "query_id long, path string, content string, self_commit long")
    attrs = spark.createDataFrame([(c, 100 + c, False) for c in range(1, 6)], "commit_id long, ts long, is_priority boolean")
    res = match_cascade(q, fv, changes, po, attrs, MatchParams(threshold=0.5, shingle_size=2))
    got = {r.query_id: (r.mode, r.preferred, r.candidates_count) for r in res["summary"].collect()}
    assert got[10] == ("exact_blob", 2, 1)
    assert got[11] == ("normalized_path", 3, 1)
    assert got[12] == ("no_match", None, 0)
    # Two kinds of no match: no path of that name, or none similar enough.
    reasons = {r.query_id: r.reason for r in res["summary"].collect()}
    assert reasons == {10: None, 11: None, 12: "no candidates"}
    plan = res["summary"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") < 25


def test_cascade_scores_order_and_modes(spark):
    """Fuzzy candidates come best first in every mode; a query of unknown
    name has no candidate paths."""
    from blobtrail.functions.content import blob_id

    words = [f"word{i}" for i in range(40)]
    near, far = words[:38] + ["other"] * 2, words[:34] + ["more"] * 6
    fv = spark.createDataFrame([(1, "d/x.txt", " ".join(far)), (2, "d/x.txt", " ".join(near)), (3, "d/x.txt", "nothing alike at all")], "commit_id long, path string, content string")
    fv = fv.withColumn("blob_id", blob_id(F.col("content"))).withColumn("log_ord", -F.col("commit_id"))
    changes = fv.select("commit_id", "path", F.lit(None).cast("string").alias("old_path"), "blob_id", F.lit("add").alias("kind"), "log_ord")
    po = fv.select("blob_id", "path", F.col("log_ord").alias("ord"))
    q = spark.createDataFrame([(10, "x.txt", " ".join(words)), (11, "unknown.txt", " ".join(words))], "query_id long, path string, content string")
    attrs = spark.createDataFrame([(c, 100 - c, False) for c in range(1, 4)], "commit_id long, ts long, is_priority boolean")
    for mode in ("jaccard", "charjaccard", "winnow", "minhash", "simhash"):
        res = match_cascade(q, fv, changes, po, attrs, MatchParams(similarity_mode=mode, threshold=0.3, shingle_size=2))
        got = {r.query_id: (r.mode, r.candidates_count, r.reason) for r in res["summary"].collect()}
        assert got[10][0] == "normalized_path" and got[10][1] >= 2, mode
        assert got[11] == ("no_match", 0, "no candidate paths")
        order = [r.commit_id for r in res["candidates"].orderBy("o").collect()]
        assert order[:2] == [2, 1], mode


def test_touching_follows_renames(spark):
    """c1 creates old.txt, c2 renames it to new.txt, c3 edits, c4 renames it
    away; c0 is an older, unrelated life of new.txt's later name."""
    rows = [("c0", "moved.txt", None, 5), ("c1", "old.txt", None, 4), ("c2", "new.txt", "old.txt", 3), ("c3", "new.txt", None, 2), ("c4", "moved.txt", "new.txt", 1),
            ("c5", "old.txt", None, 0)]
    changes = spark.createDataFrame(rows, "commit_id string, path string, old_path string, log_ord long")

    def touching(path):
        paths = spark.createDataFrame([("k", path, 0)], "k string, path string, path_rank int")
        return sorted(r.commit_id for r in H.commits_touching(paths, changes, key="k").collect())

    assert touching("new.txt") == ["c1", "c2", "c3", "c4"]
    assert touching("moved.txt") == ["c0", "c1", "c2", "c3", "c4"]
    assert touching("old.txt") == ["c1", "c2", "c5"]
