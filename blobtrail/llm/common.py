"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words: maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one of our own
    only where that setting is absent and the master is local (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="blobtrail-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads
    it back, so a lost executor costs no recomputation of what lies above and
    later readers all see one state of the rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/blobtrail-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Adds ``name`` = ``expr`` as a value that is computed once per row, even
    where lambdas read it per position: a one-element explode keeps Catalyst
    from inlining the expression. No shuffle, no further rows."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(expr)).alias(name))


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with a function from record batch to record batches, given
    whole rows; Spark partitions the work."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from fn(b)

    return df.mapInArrow(over, schema)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty. ``bytes.split()``
    splits them at exactly the ASCII white space that ends a WORD, and
    ``bytes.lower()`` lower-cases exactly A-Z."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def small(df: DataFrame, most: int) -> DataFrame:
    """Marks ``df`` (a written table) for broadcast when a count shows that it
    has at most ``most`` rows; a larger one goes into an ordinary join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
