"""The corpus pipeline: each stage applies one operator to what its
predecessor kept, written as Parquet and read again in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blobtrail.llm import mixing, near_dup, pieces, quality, secrets
from blobtrail.llm.common import shared_dir

STAGES = [
    ("quality rules", quality.stage),
    ("MinHash near-dedup", near_dup.stage),
    ("secret scans", secrets.stage),
    ("mixing sources to target weights", mixing.stage),
    ("SentencePiece encoding and decoding", pieces.stage),
]

# Keyed sampling, trained models and seeded segmentation are not SQL; tests
# compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
