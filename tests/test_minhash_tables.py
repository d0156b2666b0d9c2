import bruteforce as BF
import numpy as np
from blobtrail.functions import fingerprints as FP
from blobtrail.operators.fingerprint_tables import with_minhash
from pyspark.sql import functions as F


def test_minima_by_limbs_equal_the_formula_and_the_udf(spark):
    rng = np.random.default_rng(2)
    edge = [0, -1, 1, -(1 << 63), (1 << 63) - 1, 0xFFFF, -0x10000, 1 << 32, (1 << 48) - 1]
    rows = [(0, []), (1, edge), (2, None), (3, [0]), (3, [-1])] + [(10 + k, rng.integers(-(1 << 63), (1 << 63) - 1, int(rng.integers(1, 50))).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, h array<long>").repartition(5)
    for p in (1, 32, 33, 128):
        got = sorted((r.k, tuple(r.h or ()), tuple(r.s)) for r in with_minhash(df, "h", "s", p).collect())
        udf = sorted((r.k, tuple(r.h or ()), tuple(r.s)) for r in df.withColumn("s", FP.minhash_signature(F.col("h"), p)).collect())
        assert got == udf
        for _, h, s in got:
            a, b = FP.minhash_params(p)
            want = [min(((x * (y % 2**64) + z) % 2**64 for y in h), default=0) for x, z in zip(a, b)]
            assert [v % 2**64 for v in s] == want


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, [1, 2])], "k long, h array<long>")
    plan = with_minhash(df, "h", "s").drop("k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_signature_of_texts(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "", "one", "a b c d e f a b c d e f"]
    from blobtrail.operators.fingerprint_tables import with_fingerprint

    f = with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), "text", "minhash", k=2, num_perm=40)
    for r in f.collect():
        want = BF.minhash(set(BF.shingles(BF.tokens(texts[r.key]), 2)) if texts[r.key] else set(), 40)
        assert list(r.fp) == [BF.to_signed(v) for v in want]
