"""Joins by tiles against all pairs, and the cascade by SimHash without lists."""

import itertools
import random

import bruteforce as BF
import pytest
from blobtrail.functions.content import blob_id
from blobtrail.operators import cascade as CS
from blobtrail.operators import pairs as P
from blobtrail.operators import tiles as TI
from pyspark.sql import functions as F
from test_pairs_by_parts import near_sets


@pytest.mark.parametrize("t", [0.3, 0.8, 0.92, 1.0])
def test_sketches_lose_no_pair(spark, monkeypatch, t):
    for name, most in (("LEFT_ROWS", 7), ("RIGHT_ROWS", 11)):
        monkeypatch.setattr(TI, name, most)
    sets = near_sets(160)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "key long, items array<long>")
    got = {(r.l_key, r.r_key): r.score for r in P.set_pairs(df, None, t, by="sketch").collect()}
    want = {(a, b): s for a, b in itertools.combinations(range(len(sets)), 2) if (s := BF.jaccard(sets[a], sets[b])) >= t}
    assert got == pytest.approx(want)


def test_sketches_of_two_sides_by_block(spark):
    sets = near_sets(120)
    rows = [(f"k{k}", None if k % 11 == 0 else f"b{k % 2}", s) for k, s in enumerate(sets)]
    l, r = (spark.createDataFrame(x, "key string, name string, items array<long>") for x in (rows[:70] + rows[:3], rows[40:]))
    for skip in (False, True):
        by = {how: sorted((x.name, x.l_key, x.r_key, x.inter, x.l_n, x.r_n, x.score) for x in P.set_pairs(l, r, 0.6, block="name", skip_equal_keys=skip, by=how).collect()) for how in ("parts", "sketch")}
        assert by["sketch"] == by["parts"] and len(by["sketch"]) > 5


def test_sets_of_common_items_are_no_candidates(spark):
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(400), 200)) for _ in range(200)]
    sets.append(sorted({*sets[0][3:], 401}))
    df = spark.createDataFrame([(k, 0, s, len(s)) for k, s in enumerate(sets)], "id long, _blk int, items array<long>, n int")
    assert [tuple(r) for r in TI.sketch_candidates(df, df, 0.8, True).collect()] == [(0, 200)]


def test_simhash_cascade_writes_no_pairs(spark, monkeypatch):
    """Similar files of one name, every one near most others: counts and
    preferred commits are those of the lists, which are made when read."""
    rng, n = random.Random(11), 60
    words = [f"w{i}" for i in range(400)]
    letters = lambda w: "".join(chr(97 + int(c)) for c in w[1:])
    texts = []
    for k in range(n):
        some = [letters(w) for w in words]
        for _ in range(rng.randint(1, 12)):
            some[rng.randrange(len(some))] = letters(f"w{rng.randint(1000, 9999)}")
        texts.append(" ".join(some) if k % 9 else texts[-1] if texts else " ".join(some))
    versions = spark.createDataFrame([(k, "d/a.txt", t, -k) for k, t in enumerate(texts)], "commit_id long, path string, content string, log_ord long").withColumn("blob_id", blob_id(F.col("content")))
    changes = versions.select("commit_id", "path", F.lit(None).cast("string").alias("old_path"), F.lit("add").alias("kind"), "blob_id", "log_ord")
    queries = versions.select(F.col("commit_id").alias("query_id"), F.lit("a.txt").alias("path"), "content", F.col("commit_id").alias("self_commit"))
    attrs = spark.createDataFrame([(k, (k * 7) % 10, k in (3, 20)) for k in range(n)], "commit_id long, ts long, is_priority boolean")
    objects = versions.select("path", F.lit(0).cast("long").alias("ord")).distinct()
    sizes, plain = [], CS.written
    monkeypatch.setattr(CS, "written", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    monkeypatch.setattr(TI, "RIGHT_ROWS", 16)
    params = CS.MatchParams(similarity_mode="simhash", threshold=0.92, contains_only=True)
    out = CS.match_cascade(queries, versions, changes, objects, attrs, params)
    summary = out["summary"].where("tier = 3").collect()
    assert max(sizes) <= 8 * n and len(summary) > n / 2
    attr = {r.commit_id: r for r in attrs.collect()}
    lists = {}
    for r in out["fuzzy"].collect():
        lists.setdefault(r.blob_norm, []).append(r)
    assert sum(map(len, lists.values())) > 10 * n
    for q in summary:
        found = [r for r in lists[q.local_blob_norm] if r.commit_id != q.self_commit]
        key = lambda r: (0, 0, *r.o, r.commit_id) if attr[r.commit_id].is_priority else (1, -attr[r.commit_id].ts, *r.o, r.commit_id)
        assert (q.candidates_count, q.preferred) == (len(found), min(found, key=key).commit_id)
