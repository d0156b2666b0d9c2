import numpy as np

from blobtrail.llm import neighbours


def brute(rows, k, every):
    vectors = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        vectors[i] = min(list(map(float, v)), vectors.get(i, list(map(float, v))))
    out = []
    for q in sorted(x for x in vectors if x % every == 0):
        scored = sorted((-float(np.dot(vectors[q], v)), c) for c, v in vectors.items() if c != q and len(v) == len(vectors[q]))
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return out


def compare(spark, rows, block, k=5, every=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, v string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(df, k, every, block).collect())
    want = brute([(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]]) for r in rows], k, every)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_random_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist(), "", "") for i in range(300)]
    rows += [(300 + i, rows[7][1], "", "") for i in range(120)]  # one very common vector
    compare(spark, rows, 64)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0], "", ""), (0, [1.0, 0.0], "", ""), (1, [1.0, 0.0], "", ""), (2, None, "", ""), (3, [], "", ""), (4, [0.0, 0.0], "", ""),
        (5, [float("nan"), 1.0], "", ""), (6, [None, 1.0], "", ""), (7, [float("inf"), 1.0], "", ""), (None, [1.0, 1.0], "", ""),
        (8, [1.0, 2.0, 3.0], "", ""), (10, [1e30, -1e30], "", ""), (20, [0.5, 0.5], "", ""), (11, [2.0, 2.0], "", ""), (11, [-1.0, 2.0], "", ""),
    ]
    compare(spark, rows, 4)
    compare(spark, rows, 8192)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(df).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    a, b = (neighbours.Tile(np.arange(200), rng.normal(size=(200, 64)) * rng.exponential(size=(200, 1))) for _ in range(2))
    low, high = a.bounds(b)
    exact = a.vectors @ b.vectors.T
    assert (low <= exact).all() and (exact <= high).all()
