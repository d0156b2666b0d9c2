"""SimHash pairs and their ranks from pairs of blocks, against all pairs; values
straight from texts."""

import itertools
import random

import bruteforce as BF
import pytest
from blobtrail.functions import fingerprints as FP
from blobtrail.functions import tokens as TK
from blobtrail.operators import pairs as P
from blobtrail.operators import tiles as TI
from pyspark.sql import functions as F
from test_cells import TEXTS


def near_values(n, keys):
    """(key, value) rows: few classes of near values, some keys repeated."""
    rng = random.Random(4)
    bases = [rng.getrandbits(64) for _ in range(4)]
    turned = lambda v: v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))
    return [(rng.randrange(keys), BF.to_signed(turned(rng.choice(bases)))) for _ in range(n)] + [(None, 0), (3, None)]


def apart(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.fixture
def rows(spark, monkeypatch):
    monkeypatch.setattr(TI, "BLOCK_ROWS", 16)
    monkeypatch.setattr(TI, "GIVEN_ROWS", 50)
    sizes, plain = [], TI.written
    monkeypatch.setattr(TI, "written", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    values = near_values(220, 180)
    yield values, spark.createDataFrame(values, "key long, fp long").repartition(3)
    assert sizes and max(sizes) < 40  # blocks: neither pairs nor single rows are written


def test_pairs_of_blocks(rows):
    values, df = rows
    known = [v for v in values if None not in v]
    want = sorted((min(a, b), max(a, b), 1 - apart(x, y) / 64) for (a, x), (b, y) in itertools.combinations(known, 2) if a != b and apart(x, y) <= 6)
    got = P.simhash_pairs(df, None, 0.9, by="tiles")
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 2000
    assert "Exchange hash" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in P.simhash_pairs(df, None, 0.9).select("l_key", "r_key", "score").collect()) == want


def test_ranks_of_blocks(rows):
    values, df = rows
    known = [v for v in values if None not in v]
    lists = {}
    for (a, x), (b, y) in itertools.permutations(known, 2):
        if a != b and apart(x, y) <= 6:
            lists.setdefault(a, []).append((apart(x, y), b))
    want = sorted((a, b, 1 - d / 64, rank) for a, found in lists.items() for rank, (d, b) in enumerate(sorted(found), 1))
    assert sorted(tuple(r) for r in P.simhash_ranks(df, 0.9).collect()) == want


def test_keys_that_are_no_numbers_and_no_rows(spark):
    df = spark.createDataFrame([("b", 1), ("a", 3), ("c", -1)], "key string, fp long")
    assert [tuple(r) for r in P.simhash_pairs(df, None, 0.9, by="tiles").collect()] == [("a", "b", 1 - 1 / 64)]
    assert P.simhash_pairs(df.limit(0), None, 0.9, by="tiles").count() == 0 and P.simhash_ranks(df.limit(0), 0.9).count() == 0
    with pytest.raises(ValueError):
        P.simhash_pairs(df, df, 0.9, by="tiles")


def test_simhash_and_streams_of_texts(spark, monkeypatch):
    rng = random.Random(8)
    texts = TEXTS + ["".join(rng.choice("aaBC1 _é") for _ in range(rng.randrange(60))) for _ in range(200)]
    monkeypatch.setattr(FP, "SLICE", 200)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1)
    text = TK.nfkc(F.col("text"))
    for r in df.select("text", FP.simhash_of_text(text).alias("fp"), FP.stream_of_text(text).alias("stream")).collect():
        assert r.stream == " ".join(BF.tokens(r.text))
        assert r.fp == BF.to_signed(BF.simhash(BF.tokens(r.text)))
