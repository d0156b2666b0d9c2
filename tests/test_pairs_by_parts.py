import itertools
import random
from collections import Counter

import bruteforce as BF
import numpy as np
import pyarrow as pa
import pytest
from blobtrail.functions import fingerprints as FP
from blobtrail.functions import tokens as T
from blobtrail.operators import pairs as P
from pyspark.sql import functions as F

TEXTS = ["", "one", "two words", "alpha Beta_gamma HTTPServer42 delta", "a b c d e f a b c d e f", "naïve café x", None, "x" * 40, "one two three four five six seven " * 9]


def near_sets(n):
    """Sets of many sizes over few items, some of them near copies."""
    rng, out = random.Random(3), [[], [], [7]]
    while len(out) < n:
        base = set(rng.sample(range(150), rng.randint(1, 60)))
        for turns in range(rng.randint(1, 4)):
            out.append(sorted(base ^ set(rng.sample(range(150), turns))))
    return out[:n]


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8, 0.92, 1.0])
def test_parts_lose_no_pair(spark, t):
    sets = near_sets(160)
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "key long, items array<long>")
    got = {(r.l_key, r.r_key): r.score for r in P.set_pairs(df, None, t, by="parts").collect()}
    want = {(a, b): s for a, b in itertools.combinations(range(len(sets)), 2) if (s := BF.jaccard(sets[a], sets[b])) >= t}
    assert got == pytest.approx(want)


def test_parts_of_two_sides_by_block(spark):
    sets = near_sets(120)
    rows = [(f"k{k}", None if k % 11 == 0 else f"b{k % 2}", s) for k, s in enumerate(sets)]
    l, r = (spark.createDataFrame(x, "key string, name string, items array<long>") for x in (rows[:70], rows[40:]))
    for skip in (False, True):
        by = {how: sorted((x.name, x.l_key, x.r_key, x.inter, x.l_n, x.r_n, x.score) for x in P.set_pairs(l, r, 0.6, block="name", skip_equal_keys=skip, by=how).collect()) for how in ("prefix", "parts")}
        assert by["parts"] == by["prefix"] and len(by["parts"]) > 5


def test_common_items_make_few_meetings(spark):
    """Sets that draw on the same few items, as n-grams do: they meet often by
    prefixes, seldom by parts."""
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(400), 200)) for _ in range(200)]
    df = spark.createDataFrame([(k, 0, s, 200) for k, s in enumerate(sets)], "k long, _blk int, items array<long>, n int")
    meetings = lambda keys: sum(n * (n - 1) // 2 for n in Counter(keys).values())
    by_parts = meetings(r.part for r in P._parts(df.withColumnRenamed("k", "id"), 0.8).where("own").collect())
    by_prefix = meetings(r.item for r in P._prefixes(df, P._item_sketch(df), 0.8).collect())
    assert by_parts * 5 < by_prefix


def test_neighbours_are_not_broadcast(spark):
    df = spark.createDataFrame([(k, k * 977) for k in range(50)], "key long, fp long")
    plan = P.simhash_pairs(df, None, 0.9)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_arrow_forms_equal_the_plain_ones(spark):
    df = T.with_array(spark.createDataFrame(list(enumerate(TEXTS)), "key long, text string"), "tok", T.tokenize(F.col("text")))
    stream = T.token_stream(F.col("tok"))
    got = df.select(
        "key", FP.simhash_of_tokens(F.col("tok")).alias("sim"), FP.minhash_of_tokens(F.col("tok"), 2, 40).alias("mh"), FP.winnow_of_tokens(F.col("tok"), 2, 3).alias("win"),
        FP.shingle_keys_of_tokens(F.col("tok"), 2).alias("keys"), FP.gram_strings(stream, 5).alias("grams"), FP.gram_keys(stream, 5).alias("gk"), FP.gram_keys(stream, 9).alias("g9"),
    ).collect()
    for r in got:
        toks = BF.tokens(TEXTS[r.key])
        sh = BF.shingles(toks, 2) if toks else []
        hashes, line = [BF.h64(x) for x in sh], " ".join(toks)
        grams = lambda n: sorted({line[i : i + n] for i in range(max(1, len(line) - n + 1))}) if line else []
        assert r.sim % 2**64 == BF.simhash(toks)
        assert list(r.mh) == [BF.to_signed(v) for v in BF.minhash(set(sh), 40)]
        w = min(3, len(hashes))
        assert {x % 2**64 for x in r.win} == {min(hashes[i : i + w]) for i in range(len(hashes) - w + 1 if w else 0)}
        assert len(r["keys"]) == len(set(r["keys"])) == len(set(sh))
        assert list(r.grams) == grams(5) and len(set(r.gk)) == len(grams(5)) and len(set(r.g9)) == len(grams(9))


def test_shingle_keys_agree_across_texts_and_batches():
    one = FP._keys_of_row(np.array([5, 9, 5, 9, 7], np.uint64), 2)
    assert len(one) == 3 and set(FP._keys_of_row(np.array([5, 9], np.uint64), 2)) < set(one)
    assert not set(FP._keys_of_row(np.array([5], np.uint64), 2)) & set(one)


def test_rows_are_worked_on_in_slices():
    n = np.array([3, 4, 0, 9, 1, 1, 0])
    assert list(FP.row_slices(n, 7)) == [(0, 3), (3, 4), (4, 7)]
    assert list(FP.row_slices(np.array([], np.int64), 7)) == []
    assert FP._lengths(pa.array([[1], None, [], [2, 3]])).tolist() == [1, 0, 0, 2]
