"""Overlays of many hint paths: contents are compared once per path and name."""

from blobtrail.functions.content import blob_id
from blobtrail.operators import cascade as CS
from pyspark.sql import functions as F


def test_overlays_share_their_contents(spark, monkeypatch):
    """Every hint touches all commits, as after renames, so every overlay holds
    all versions of the name."""
    paths, n = [f"d{i}/x.txt" for i in range(8)], 24
    body = lambda c: " ".join(f"w{(c * 5 + i) % 997}" for i in range(12))
    fv = spark.createDataFrame([(c, paths[c % 8], body(c)) for c in range(n)], "commit_id long, path string, content string")
    fv = fv.withColumn("blob_id", blob_id(F.col("content"))).withColumn("log_ord", -F.col("commit_id"))
    touched = spark.createDataFrame([(c, p) for c in range(n) for p in paths], "commit_id long, path string")
    changes = touched.select("commit_id", "path", F.lit(None).cast("string").alias("old_path"), F.lit("0" * 40).alias("blob_id"), F.lit("add").alias("kind"), (-F.col("commit_id")).alias("log_ord"))
    objects = fv.select("blob_id", "path", F.col("log_ord").alias("ord"))
    attrs = fv.select("commit_id", F.col("commit_id").alias("ts"), F.lit(False).alias("is_priority"))
    # One word more than a version's text: similar, not equal.
    files = spark.createDataFrame([(q, "x.txt", body(q) + " more", paths[(q + 3) % 8]) for q in range(n)], "query_id long, path string, content string, hint string")
    made, real = [], CS.with_fingerprint

    def counted(df, *args, **kw):
        out = real(df, *args, **kw)
        made.append(out.count())
        return out

    monkeypatch.setattr(CS, "with_fingerprint", counted)
    out = CS.match_cascade(files, fv, changes, objects, attrs, CS.MatchParams(threshold=0.5, shingle_size=2))
    got = {r.query_id: (r.mode, r.preferred) for r in out["summary"].collect()}
    assert got == {q: ("normalized_path", q) for q in range(n)}
    assert sum(made) <= 6 * n  # 8 overlays that each hold all versions made 11 n
