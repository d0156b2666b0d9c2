"""A1: query files landed in a folder, read against a manifest.

Where all executors share the folder as files, tasks open the files that the
manifest names, after a look for missing ones: nothing is listed, so no process
holds the names of all files, and no content is shuffled.

Any other store is read with the ``binaryFile`` source, whose columns are pruned:
which files are there, and how long, is known from the listing alone (which the
driver holds), so a listed file that is missing is found by an anti-join before
any content is read, and lengths never read one. Contents come from the join of
the manifest with the files, one shuffle by path.

``land_texts`` writes such a folder: its tasks write the files themselves, as
Spark's writer takes a directory, a committed task file and a move by the driver
for each of them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from blobtrail.operators.cascade import prepare_queries

SHOWN = 20  # missing paths named in an error
FOLDERS = 256  # that landed files are dealt to, so that they are listed in parallel
READ_BYTES = 1 << 24  # of contents given at a time, or a single file


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as the source spells it in its ``path`` column."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return str(path.getFileSystem(conf).makeQualified(path)).rstrip("/")


def landed_path(key: Column) -> Column:
    """Where ``land_texts`` puts the texts of an id."""
    at = F.lower(F.lpad(F.hex(F.pmod(F.xxhash64(key), F.lit(FOLDERS))), 2, "0"))
    return F.concat(at, F.lit("/id="), F.coalesce(key.cast("string"), F.lit("")), F.lit(".txt"))


def land_texts(texts: DataFrame, folder: str) -> int:
    """Lands (id, text) as a file ``landed_path(id)`` per id below ``folder``, a
    plain path or file URL that all executors share; every text ends in a line
    feed, the texts of one id share its file. A file is moved into place whole,
    so a task that is tried again writes the same. Gives the number of files."""
    root = folder.removeprefix("file://").removeprefix("file:")
    if ":/" in root:
        raise ValueError(f"give the path of a folder that all executors share, not {folder!r}")

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, temp, n = None, None, "", 0

        def close() -> None:
            if out:
                out.close()
                os.replace(temp, os.path.join(root, now))

        for batch in batches:
            for path, text in zip(*(batch.column(c).to_pylist() for c in ("path", "text")), strict=True):
                if path != now:
                    close()
                    now, n = path, n + 1
                    at = os.path.join(root, os.path.dirname(path))
                    os.makedirs(at, exist_ok=True)
                    temp = os.path.join(at, f".{uuid.uuid4().hex}")
                    out = open(temp, "wb")  # noqa: SIM115
                out.write((text or "").encode() + b"\n")
        close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    dealt = texts.select(landed_path(F.col("id")).alias("path"), "text").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(land, "n long").agg(F.sum("n")).first()[0] or 0


def landed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified, content) of every file below ``folder``, path
    relative to it. Columns that aren't asked for aren't read."""
    root = qualified(spark, folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.substr("path", F.lit(len(root) + 2))
    return files.select(inside.alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def unscanned(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct paths of the manifest that the scan doesn't give: missing ones,
    and empty files, which Spark's scans leave out."""
    return manifest.select("path").distinct().join(files.select("path"), "path", "left_anti")


def missing(spark: SparkSession, paths: DataFrame, folder: str, most: int) -> list[str]:
    """The first ``most`` of ``paths`` that are no file in the folder. Asked of
    the file system one by one, for the paths that a scan left out alone."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out, fs = [], jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
    for r in paths.orderBy("path").toLocalIterator():
        if r["path"] is None or not fs.isFile(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{r['path']}")):
            out.append(str(r["path"]))
            if len(out) >= most:
                break
    return out


def _place(root: str, path: str | None) -> str | None:
    """Where a path of the manifest lies; null where it isn't below the root."""
    at = None if path is None else os.path.normpath(os.path.join(root, path))
    return at if at and at.startswith(f"{os.path.normpath(root)}/") else None


def missing_of(manifest: DataFrame, root: str, most: int) -> list[str]:
    """The first ``most`` paths of the manifest that are no file below the folder
    ``root``, which all executors share; looked for by the tasks."""

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at := _place(root, path)) is not None and os.path.isfile(at) for path in batch.column("path").to_pylist()]
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    paths = manifest.select("path").mapInArrow(gone, "path string").distinct().orderBy("path").limit(most)
    return [str(r["path"]) for r in paths.collect()]


def with_contents(manifest: DataFrame, root: str) -> DataFrame:
    """The manifest with ``length`` and ``content`` of its files below the folder
    ``root``, which all executors share; the tasks that hold its rows read them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, first, held, size = batch.column("path").to_pylist(), 0, [], 0
            for i, path in enumerate(paths, 1):
                with open(_place(root, path) or "", "rb") as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= READ_BYTES or i == len(paths):
                    rows = batch.slice(first, i - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(map(len, held), pa.int64()), pa.array(held, pa.binary())], [*rows.schema.names, "length", "content"])
                    first, held, size = i, [], 0

    given = manifest.select("path", *[c for c in manifest.columns if c != "path"])
    return given.mapInArrow(read, StructType([*given.schema.fields, StructField("length", LongType()), StructField("content", BinaryType())]))


def read_query_files(spark: SparkSession, manifest: DataFrame, folder: str, crlf: bool = False) -> DataFrame:
    """The files that ``manifest`` (query_id, path, …) lists, with their
    LF-normalised content and ids as ``prepare_queries`` gives them, and
    ``length`` as landed. Raises FileNotFoundError, naming paths, where a
    listed file is missing or a row has no path. Files that aren't listed are
    left alone; a file listed twice is two queries; an empty file is one."""
    root = qualified(spark, folder)
    if root.startswith("file:"):
        root = root.removeprefix("file://").removeprefix("file:")
        gone, found = missing_of(manifest, root, SHOWN + 1), with_contents(manifest, root)
    else:
        files = landed_files(spark, folder)
        gone = missing(spark, unscanned(manifest, files), folder, SHOWN + 1)
        found = manifest.join(files.select("path", "length", "content"), "path", "left")
    if gone:
        raise FileNotFoundError(f"listed but not in {folder}: {', '.join(gone[:SHOWN])}{' and more' if len(gone) > SHOWN else ''}")
    found = found.withColumn("length", F.coalesce("length", F.lit(0).cast("long"))).withColumn("content", F.coalesce("content", F.lit(b"")))
    return prepare_queries(found, crlf)
