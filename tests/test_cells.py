"""Pairs checked in cells against a join of whole rows; texts of both sides
have their fingerprint made once; shingle keys straight from texts."""

import random

import bruteforce as BF
import pytest
from blobtrail.functions import fingerprints as FP
from blobtrail.functions import tokens as TK
from blobtrail.operators import cascade as CS
from blobtrail.operators import pairs as P
from blobtrail.operators import tiles as TI
from pyspark.sql import functions as F
from test_pairs_by_parts import near_sets


@pytest.mark.parametrize("self_join", [False, True])
def test_cells_equal_a_join(spark, monkeypatch, self_join):
    monkeypatch.setattr(TI, "CELL_WORDS", 300)
    rng = random.Random(3)
    rows = [(k % 50, None if k % 13 == 0 else f"k{k}", f"b{k % 3}", s, len(s)) for k, s in enumerate(near_sets(90)) if s]
    schema = "id long, k string, _blk string, items array<long>, n int"
    left, right = rows[:60], rows if self_join else rows[30:]
    left = rows if self_join else left
    pairs = sorted({(rng.randrange(55), rng.randrange(55)) for _ in range(700)})
    got = TI.in_cells(spark.createDataFrame(pairs, "l_id long, r_id long"), spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), self_join, TI.common_items, lambda a, b, i: i >= 2)
    want = []
    for l_id, r_id in pairs:
        for a in (x for x in left if x[0] == l_id):
            for b in (x for x in right if x[0] == r_id):
                inter = len({*a[3]} & {*b[3]})
                if a[1] and b[1] and a[2] == b[2] and inter >= 2:
                    want.append((a[1], b[1], a[2], a[4], b[4], inter))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20


def test_a_class_moves_each_set_few_times(spark):
    base = list(range(1000, 1200))
    rows = [(k, base + [k]) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, items array<long>")
    sets = P._named(df.select(F.col("key").alias("k"), F.lit(0).alias("_blk"), "items", F.size("items").alias("n")))
    every = [(a, b) for a in range(60) for b in range(60) if a != b]
    for pairs, self_join in ((every, False), ([p for p in every if p[0] < p[1]], True)):
        met = spark.createDataFrame(pairs, "l_id long, r_id long")
        ls, rs = TI._cell_sides(met, sets, sets, self_join)
        cells = met.join(ls, "l_id").join(rs, "r_id")
        assert cells.select("l_id", "lc", "rc").distinct().count() <= 3 * 60


def test_equal_texts_of_both_sides_have_one_fingerprint(spark, monkeypatch):
    made, plain = [], CS.with_fingerprint

    def counted(df, *a, **kw):
        made.append(df.count())
        return plain(df, *a, **kw)

    monkeypatch.setattr(CS, "with_fingerprint", counted)
    texts = [f"one two three four five six seven {'x' * (k % 7)}" for k in range(20)]
    queries = spark.createDataFrame([("n", f"q{k}", t) for k, t in enumerate(texts)], "name string, blob_norm string, text string")
    files = spark.createDataFrame([(k, "p", t) for k, t in enumerate([*texts, "only here", texts[0] + "\r\n"])] + [(3, "p", "again at three")], "commit_id long, path string, content string")
    versions = spark.createDataFrame([("n", f"v{k}", k, "p") for k in range(22)], "name string, nblob string, commit_id long, path string")
    ql, vr = CS.content_fingerprints(queries, versions, files, CS.MatchParams())
    assert made == [20, 3]  # the two texts of versions alone, and the repeated version's other content
    assert sorted(r.key for r in vr.collect()) == sorted([f"v{k}" for k in range(22)] + ["v3"])
    fp = {r.key: tuple(r.fp) for r in ql.collect()}
    for r in vr.collect():
        k = int(r.key[1:])
        if k < 20 and k != 3:
            assert tuple(r.fp) == fp[f"q{k}"]


TEXTS = [
    "", None, "one", "HTTPServer42 aB Bc ABc ABCd a1B2 snake_case X", "XY", "XYz", "xY", "9lives", "é", "naïve ＦＵＬＬ width ﬁne ① x²",
    "a b c d e f a b c d e f", "a" * 8, "a" * 9, "a" * 17 + " " + "a" * 16, "B" * 40 + "c", "\0a\0 b", "end A", "A", "x" * 5000 + "Y",
]


@pytest.mark.parametrize("k", [1, 2, 5])
def test_shingle_keys_of_texts(spark, monkeypatch, k):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("aaBC1 _é") for _ in range(rng.randrange(60))) for _ in range(300)]
    monkeypatch.setattr(FP, "SLICE", 200)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    got = {r.k: r.s for r in df.select("k", FP.shingle_keys_of_text(TK.nfkc(F.col("text")), k).alias("s")).collect()}
    key_of = {}
    for i, t in enumerate(texts):
        want = set(BF.shingles(BF.tokens(t or ""), k)) if t else set()
        assert len(got[i]) == len({*got[i]}) == len(want), t
        for s in want:  # a shingle has the same key wherever it stands
            key_of.setdefault(s, set(got[i]))
            key_of[s] &= set(got[i])
    assert all(key_of.values()) and len({x for v in got.values() for x in v}) == len(key_of)


def test_jaccard_sets_need_no_token_arrays(spark, monkeypatch):
    from blobtrail.operators import fingerprint_tables as FT

    monkeypatch.setattr(FT, "written", lambda df: df)
    df = FT.with_fingerprint(spark.createDataFrame([(1, "a b")], "k int, text string"), "text", "jaccard")
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
