"""n-gram sets made from token streams where they are compared."""

import itertools
import random

import bruteforce as BF
import pytest
from blobtrail.functions import fingerprints as FP
from blobtrail.operators import cascade as CS
from blobtrail.operators import pairs as P
from blobtrail.operators import tiles as TI
from blobtrail.plans import registry
from pyspark.sql import functions as F


def grams(stream, n):
    return {stream[i : i + n] for i in range(max(1, len(stream) - n + 1))} if stream else set()


def streams(count):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    out = ["", "", "a", "ab c"]
    while len(out) < count:
        some = rng.choices(words, k=rng.randint(3, 40))
        for _ in range(rng.randint(1, 4)):
            some[rng.randrange(len(some))] = rng.choice(words)
            out.append(" ".join(some))
    return out[:count]


@pytest.mark.parametrize("n", [1, 5, 9])
def test_scores_of_streams(spark, n):
    pairs = list(itertools.product(streams(24), repeat=2))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.s for r in df.select(FP.gram_jaccard(F.col("a"), F.col("b"), n).alias("s")).collect()]
    assert got == pytest.approx([BF.jaccard(grams(a, n), grams(b, n)) for a, b in pairs])


def test_joins_of_streams(spark, monkeypatch):
    monkeypatch.setattr(TI, "LEFT_ROWS", 16)
    monkeypatch.setattr(TI, "CELL_WORDS", 500)
    texts = streams(120)
    df = spark.createDataFrame([(k, f"b{k % 2}", s) for k, s in enumerate(texts)], "key long, name string, fp string")
    score = {(a, b): BF.jaccard(grams(texts[a], 5), grams(texts[b], 5)) for a, b in itertools.combinations(range(len(texts)), 2)}
    for t in (0.5, 0.92):
        got = {(r.l_key, r.r_key): r for r in P.set_pairs(df, None, t, items="fp", by="sketch", grams=5).collect()}
        want = {p: s for p, s in score.items() if s >= t}
        assert {p: r.score for p, r in got.items()} == pytest.approx(want) and len(want) > 5
        assert all((r.l_n, r.r_n) == tuple(max(1, len(grams(texts[k], 5))) for k in p) for p, r in got.items())
    both = P.set_pairs(df, df, 0.5, items="fp", block="name", skip_equal_keys=True, by="sketch", grams=5).collect()
    assert sorted((r.l_key, r.r_key) for r in both if r.l_key < r.r_key) == sorted(p for p, s in score.items() if s >= 0.5 and (p[1] - p[0]) % 2 == 0)
    with pytest.raises(ValueError):
        P.set_pairs(df, None, 0.5, items="fp", grams=5)


def test_sets_of_grams_are_neither_written_nor_moved(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 3} of some words", "en", "s") for k in range(60)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.load_all()["charjaccard_score"].fn(registry.repo_for(spark, str(tmp_path)))
    plan = df._jdf.queryExecution().optimizedPlan()
    assert "array<" not in plan.output().mkString() and "regexp_extract_all" not in plan.toString()
    assert {r.doc_id: r.score for r in df.collect()}[20] == round(BF.jaccard(grams("text 2 of some words", 5), grams("text 0 of some words", 5)), 6)
    queries = docs.select(F.lit("n").alias("name"), F.col("doc_id").cast("string").alias("blob_norm"), "text")
    versions = spark.createDataFrame([("n", "v", 1, "p")], "name string, nblob string, commit_id long, path string")
    files = docs.select(F.col("doc_id").alias("commit_id"), F.lit("p").alias("path"), F.col("text").alias("content"))
    ql, vr = CS.content_fingerprints(queries, versions, files, CS.MatchParams(similarity_mode="charjaccard"))
    assert dict(ql.dtypes)["fp"] == dict(vr.dtypes)["fp"] == "string"
