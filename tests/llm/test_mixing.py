import duckdb
import pytest
from pyspark.sql import functions as F

from blobtrail.llm import mixing


def mixed(df):
    return mixing.mix(df, mixing.size_of(F.col("text")), mixing.quality_weight(F.col("text"))).collect()


def test_agrees_with_sql_and_reruns(spark, sample):
    got = sorted(tuple(r)[:5] for r in mixed(sample))
    assert got == sorted(tuple(r)[:5] for r in mixed(sample))
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(mixing.ORACLE_SQL).fetchall()
    assert got == sorted((a, b, c, pytest.approx(d), e) for a, b, c, d, e in want)


def test_targets_and_limits(spark, sample):
    rows = mixed(sample)
    by_source = {}
    ids = {r["doc_id"]: r["source"] for r in sample.select("doc_id", "source").collect()}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        by_source.setdefault(ids[r["doc_id"]], []).append(r)
    for docs_ in by_source.values():
        assert abs(sum(r["taken"] for r in docs_) - docs_[0]["target"]) <= max(r["size"] for r in docs_)
        assert docs_[0]["target"] <= 2 * docs_[0]["source_size"]


def test_awkward_rows(spark, docs, no_docs):
    rows = mixed(docs)
    assert len(rows) == docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mixed(no_docs) == []
    left = mixing.stage(spark, docs, "")
    assert left.columns == docs.columns
    assert left.agg(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10, 1, 1.0), ("b", 1000, 1, 1.0), ("c", 1000, 1, 1.0), (None, 5, 1, 1.0)], "source string, source_size long, n_docs long, mean_weight double")
    got = {r["source"]: r["target"] for r in mixing.with_targets(mixing.ranked_sources(sizes), mixing.WEIGHTS, mixing.SHARE).collect()}
    # Shares 3, 1, 2 and (null, last) 3 of 3022.5; a and null stop at 20 and 10.
    assert got["a"] == 20 and got[None] == 10
    assert got["b"] == pytest.approx(2992.5 / 3) and got["c"] == pytest.approx(2992.5 * 2 / 3)
