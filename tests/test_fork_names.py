import random

from blobtrail.operators import forks as FK
from pyspark.sql import functions as F


def folded(rows, existing):
    """Names by the rule, one fork after the other."""
    used, out = {}, {}
    for target, name in existing:
        used.setdefault(target, set()).add(name)
    for target, pos, owner, repo in sorted(rows, key=lambda r: (r[0], r[1])):
        taken, base, i = used.setdefault(target, set()), f"fork_{owner}_{repo}", 0
        while (base if i == 0 else f"{base}_{i}") in taken:
            i += 1
        out[(target, pos)] = base if i == 0 else f"{base}_{i}"
        taken.add(out[(target, pos)])
    return out


def named(spark, rows, existing):
    usable = spark.createDataFrame(rows, "target string, pos long, owner_login string, repo_name string")
    got = FK.unique_remote_names(usable, spark.createDataFrame(existing, "target string, remote string"))
    return {(r.target, r.pos): r.remote for r in got.collect()}


def test_names_against_the_fold_with_nested_contests(spark):
    rng = random.Random(6)
    rows, existing = [], []
    for t in range(12):
        for pos in range(1, rng.randrange(2, 40)):
            repo = "r" + "".join(f"_{rng.randrange(4)}" for _ in range(rng.choice([0, 0, 0, 1, 1, 2])))
            rows.append((f"t{t}", pos, rng.choice(["u", "u", "v"]), repo))
        existing += [(f"t{t}", f"fork_u_r{rng.choice(['', '_1', '_2', '_1_1', '_03', '_7', '_x'])}") for _ in range(rng.randrange(4))] + [(f"t{t}", "origin"), (f"t{t}", None)]
    rng.shuffle(rows)
    assert named(spark, rows, existing) == folded(rows, existing)
    assert named(spark, rows, []) == folded(rows, [])


def test_ten_thousand_forks_of_one_target(spark):
    rows = [("hot", pos, "u", "r") for pos in range(1, 9991)] + [("hot", 9991 + k, "u", f"r_{k * 1000 + 5}") for k in range(9)] + [("hot", 0, "u", "r_17"), ("cold", 3, "u", "r")]
    existing = [("hot", "fork_u_r"), ("hot", "fork_u_r_9"), *[("hot", f"fork_u_r_{i}") for i in range(2000, 3000)]]
    assert named(spark, rows, existing) == folded(rows, existing)


def test_no_forks(spark):
    empty = spark.createDataFrame([], "target string, pos long, owner_login string, repo_name string")
    assert FK.unique_remote_names(empty, empty.select("target", F.col("repo_name").alias("remote"))).count() == 0
