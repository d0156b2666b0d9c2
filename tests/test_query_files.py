import os

import pytest
from blobtrail.functions.content import blob_id
from blobtrail.operators import query_files as QF
from pyspark.sql import functions as F


def land(folder, files):
    for path, content in files.items():
        at = os.path.join(folder, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as out:
            out.write(content)


def test_files_written_from_documents(spark, tmp_path, sample_texts):
    files = {f"{d % 7}/sub dir/{d}.txt": (t.replace("\n", "\r\n") if d % 2 else t).encode() for d, t in sample_texts.items()}
    land(f"{tmp_path}/in", files | {"not/listed.txt": b"x"})
    manifest = spark.createDataFrame([(d, f"{d % 7}/sub dir/{d}.txt", "extra") for d in sample_texts], "query_id long, path string, note string")
    got = {r.query_id: r for r in QF.read_query_files(spark, manifest, f"{tmp_path}/in").collect()}
    ids = spark.createDataFrame([(d, t.replace("\r\n", "\n").replace("\r", "\n")) for d, t in sample_texts.items()], "d long, t string").select("d", blob_id(F.col("t")).alias("b"))
    want = {r.d: r.b for r in ids.collect()}
    assert set(got) == set(want)
    for d, r in got.items():
        assert r.blob_norm == want[d] and r.length == len(files[r.path]) and r.note == "extra"
        assert r.name == f"{d}.txt"


def test_missing_files_raise_with_their_paths(spark, tmp_path):
    land(f"{tmp_path}/in", {"a.txt": b"a", "b/c.txt": b"", "é%20x.txt": b"bytes \xff\x00 end"})
    rows = [(1, "a.txt"), (2, "b/c.txt"), (3, "é%20x.txt"), (4, "a.txt")]
    df = spark.createDataFrame(rows, "query_id long, path string")
    got = {r.query_id: (r.length, r.text) for r in QF.read_query_files(spark, df, f"{tmp_path}/in").collect()}
    assert got == {1: (1, "a"), 2: (0, ""), 3: (12, "bytes \x00 end"), 4: (1, "a")}
    more = spark.createDataFrame([*rows, (5, "b/gone.txt"), (6, None)], "query_id long, path string")
    with pytest.raises(FileNotFoundError, match=r"b/gone\.txt"):
        QF.read_query_files(spark, more, f"{tmp_path}/in")
    assert QF.read_query_files(spark, df.limit(0), f"{tmp_path}/in").count() == 0


def test_lengths_and_the_check_read_no_content(spark, tmp_path):
    land(f"{tmp_path}/in", {"a.txt": b"a" * 1000})
    files = QF.landed_files(spark, f"{tmp_path}/in")
    plan = files.select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    os.chmod(f"{tmp_path}/in/a.txt", 0)  # a content can't be read now, a length can
    assert files.agg(F.sum("length")).first()[0] == 1000


@pytest.fixture(scope="module")
def sample_texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}


def test_texts_land_from_tasks_without_a_directory_each(spark, tmp_path):
    rows = [(k, None if k == 3 else f"text {k}\r\nä") for k in range(40)] + [(7, "again")]
    texts = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for _ in range(2):  # landed again, the files are the same
        assert QF.land_texts(texts, f"file:{tmp_path}/in") == 40
    files = [os.path.relpath(os.path.join(d, f), f"{tmp_path}/in") for d, _, fs in os.walk(f"{tmp_path}/in") for f in fs]
    assert len(files) == 40 and all(len(f.split("/")[0]) == 2 for f in files)
    manifest = texts.select(F.col("id").alias("query_id"), QF.landed_path(F.col("id")).alias("path")).distinct()
    got = {r.query_id: bytes(r.content) for r in QF.read_query_files(spark, manifest, f"{tmp_path}/in").collect()}
    assert got.keys() == set(range(40)) and got[3] == b"\n"
    assert sorted(got[7].split(b"\n")) == sorted([b"text 7\r", "ä".encode(), b"again", b""])
    with pytest.raises(ValueError):
        QF.land_texts(texts, "hdfs://host/in")


def test_shared_files_are_not_listed(spark, tmp_path, monkeypatch):
    """Tasks open what the manifest names; no file list is held or joined."""
    monkeypatch.setattr(QF, "READ_BYTES", 10)
    land(f"{tmp_path}/in", {f"{k % 3}/{k}.txt": b"x" * k for k in range(40)} | {"_kept/.too": b"y\r\n"})
    rows = [(k, f"{k % 3}/{k}.txt") for k in range(40)] + [(40, "_kept/.too"), (41, "0/9.txt")]
    df = spark.createDataFrame(rows, "query_id long, path string").repartition(2)
    out = QF.read_query_files(spark, df, f"{tmp_path}/in")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" not in plan and "Join" not in plan
    got = {r.query_id: (r.path, r.length, bytes(r.content_lf)) for r in out.collect()}
    assert got == {k: (p, *((3, b"y\n") if k == 40 else (int(p[2:-4]), b"x" * int(p[2:-4])))) for k, p in rows}
    for bad in ("../in/1/1.txt/..", "1", "/etc/hostname"):
        with pytest.raises(FileNotFoundError):
            QF.read_query_files(spark, spark.createDataFrame([(1, bad)], "query_id long, path string"), f"{tmp_path}/in")
