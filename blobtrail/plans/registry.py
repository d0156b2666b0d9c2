"""Registry of named queries: each is a Spark job over one scale-factor
directory, paired (where SQL can say it) with an independent DuckDB oracle
query over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from blobtrail.sources.testdata import Repo


@dataclass
class Entry:
    name: str
    op_id: str
    fn: Callable[[Repo], DataFrame]
    sql: str | Callable[[], str] | None


REGISTRY: dict[str, Entry] = {}
# Tables by (application, folder); those of ended applications are dropped.
_REPOS: dict[tuple[str, str], Repo] = {}


def register(name: str, op_id: str, sql: str | Callable[[], str] | None = None):
    def deco(fn: Callable[[Repo], DataFrame]):
        REGISTRY[name] = Entry(name, op_id, fn, sql)
        return fn

    return deco


def repo_for(spark: SparkSession, sf_dir: str) -> Repo:
    app = spark.sparkContext.applicationId
    key = (app, sf_dir.rstrip("/"))
    for old in [k for k in _REPOS if k[0] != app]:
        del _REPOS[old]
    if key not in _REPOS:
        _REPOS[key] = Repo(spark, sf_dir.rstrip("/"))
    return _REPOS[key]


def forget() -> None:
    """Drops all derived tables, so that the next query builds its own."""
    _REPOS.clear()


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY[name].fn(repo_for(spark, sf_dir))


def oracle(name: str) -> str | None:
    sql = REGISTRY[name].sql
    return sql() if callable(sql) else sql


def load_all() -> dict[str, Entry]:
    # Importing the query modules fills the registry.
    from blobtrail.plans import q_catalog, q_content, q_history, q_match, q_snapshots  # noqa: F401

    return REGISTRY
