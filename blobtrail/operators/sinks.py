"""A4, A5 sinks: reports and env files, written by a Python data source.

``report_lines`` and ``env_lines`` turn the report and env tables into lines
(section, ord, line); the data source ``blobtrail_lines`` writes them to a
folder that all executors share. Every task streams its sorted lines into a
file of its own in a staging folder; ``commit`` moves the files into place and
writes ``_SUCCESS`` last, ``abort`` (or a task's own failure) removes what was
staged, so a reader never sees a part of a failed write. The path is a plain
one (a mounted shared folder), as Python code opens it.

A section is one query's report or env pairs, or one candidate list: lists
belong to content groups that many queries share, so a list is written once,
under its group's name, and each query's report names it."""

from __future__ import annotations

import contextlib
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

# --- fixed values ----------------------------------------------------------
FORMAT = "blobtrail_lines"
SUCCESS = "_SUCCESS"
LINES = "section string, ord long, line string"
BRANCH_SEP = "\t\n"
# ---------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    path: str
    sections: int
    lines: int


class LineWriter(DataSourceWriter):
    """Writes rows (section, ord, line), sections apart by an empty line.
    Line breaks inside a line stay; a section starts with its name in
    brackets."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.run = uuid.uuid4().hex
        self.staging = os.path.join(path, f"_staging-{self.run}")
        os.makedirs(self.staging)  # by the driver, so a late task of an aborted write finds none

    def write(self, rows: Iterator) -> Staged:
        name = os.path.join(self.staging, f"{uuid.uuid4().hex}.txt")
        now, sections, lines = None, 0, 0
        try:
            with open(name, "w", encoding="utf-8", newline="") as out:
                for row in rows:
                    if row["section"] != now:
                        out.write(f"\n[{row['section']}]\n" if sections else f"[{row['section']}]\n")
                        now, sections = row["section"], sections + 1
                    out.write(f"{row['line']}\n")
                    lines += 1
        except BaseException:
            with contextlib.suppress(FileNotFoundError):
                os.unlink(name)
            raise
        return Staged(name, sections, lines)

    def commit(self, messages: list[Staged | None]) -> None:
        """Only what the successful attempts name is moved into place."""
        done = [m for m in messages if m is not None and m.lines]
        old = [f for f in os.listdir(self.path) if f.startswith("part-") or f == SUCCESS] if self.overwrite else []
        for f in old:
            os.unlink(os.path.join(self.path, f))
        for k, m in enumerate(done):
            os.replace(m.path, os.path.join(self.path, f"part-{k:05d}-{self.run}.txt"))
        shutil.rmtree(self.staging, ignore_errors=True)
        with open(os.path.join(self.path, SUCCESS), "w", encoding="utf-8") as out:
            out.write(f"sections={sum(m.sections for m in done)}\nlines={sum(m.lines for m in done)}\n")

    def abort(self, messages: list[Staged | None]) -> None:
        for _ in range(100):  # tasks that are being cancelled may still write
            shutil.rmtree(self.staging, ignore_errors=True)
            if not os.path.exists(self.staging):
                break
            time.sleep(0.1)


class LineFiles(DataSource):
    """``df.write.format("blobtrail_lines")`` for rows of ``LINES``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def writer(self, schema: StructType, overwrite: bool) -> LineWriter:
        if schema.fieldNames() != ["section", "ord", "line"]:
            raise ValueError(f"rows must be ({LINES}), not {schema.simpleString()}")
        path = self.options.get("path")
        if not path or "://" in path:
            raise ValueError("give the path of a folder that all executors share")
        return LineWriter(path, overwrite)


def list_name(name, blob_norm, tier):
    """Section of a group's candidate list."""
    return F.concat_ws(" ", F.lit("list"), F.coalesce(name, F.lit("-")), blob_norm, tier.cast("string"))


def report_lines(report: DataFrame, summary: DataFrame, candidates: DataFrame) -> DataFrame:
    """A4 as lines: a section per query with its head, ending in the name of
    its candidate list, and a section per list, its lines by rank.

    ``report``: of ``match_report``; ``summary``: of the cascade (query_id,
    name, tier); ``candidates``: of ``candidate_lines``."""
    which = summary.select("query_id", "name", "tier")
    named = F.when(F.col("tier") == 1, F.lit(None).cast("string")).otherwise(F.col("name"))
    heads = report.select("query_id", "local_blob_norm", "report_head").join(which, "query_id").select(
        F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("section"),
        F.lit(0).cast("long").alias("ord"),
        F.concat(F.col("report_head"), F.when(F.col("tier").isNotNull(), F.concat(F.lit(" "), list_name(named, F.col("local_blob_norm"), F.col("tier")))).otherwise(F.lit(""))).alias("line"),
    )
    lists = candidates.select(list_name(F.col("name"), F.col("blob_norm"), F.col("tier")).alias("section"), F.col("rank").cast("long").alias("ord"), "line")
    return heads.unionByName(lists)


def env_lines(env: DataFrame, summary: DataFrame) -> DataFrame:
    """A5 as lines: a section per query of its KEY=value pairs; the pair
    CANDIDATE_COMMITS names the query's list, whose commits are the list's
    lines in order (``candidate_commits``)."""
    order = ["PREFERRED_COMMIT", "CANDIDATE_COMMITS", "MATCH_MODE", "FORKS_FETCHED", "FORKS_DISCOVERED", "FORKS_SELECTED", "PREFERRED_BRANCH", "PREFERRED_BRANCHES"]
    named = F.when(F.col("tier") == 1, F.lit(None).cast("string")).otherwise(F.col("name"))
    shared = summary.where("tier IS NOT NULL").select(
        "query_id", F.lit("CANDIDATE_COMMITS").alias("key"), list_name(named, F.col("local_blob_norm"), F.col("tier")).alias("value")
    )
    pairs = env.unionByName(shared)
    return pairs.select(
        F.concat(F.lit("query "), F.col("query_id").cast("string")).alias("section"),
        F.array_position(F.array(*[F.lit(k) for k in order]), F.col("key")).cast("long").alias("ord"),
        F.concat("key", F.lit("="), "value").alias("line"),
    )


def candidate_commits(report: DataFrame, summary: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, key, value): CANDIDATE_COMMITS written out for ``queries``
    (query_id), the ranked commits without the query's own one. For the
    queries asked for only: each gets a copy of its group's list."""
    which = summary.join(queries.select("query_id").distinct(), "query_id").where("tier IS NOT NULL")
    named = F.when(F.col("tier") == 1, F.lit("")).otherwise(F.coalesce("name", F.lit("")))
    wanted = which.select("query_id", "self_commit", named.alias("_name"), F.col("local_blob_norm").alias("blob_norm"), "tier")
    each = candidates.select(F.coalesce("name", F.lit("")).alias("_name"), "blob_norm", "tier", "rank", "commit_id")
    rows = wanted.join(each, ["_name", "blob_norm", "tier"]).where("self_commit IS NULL OR commit_id <> self_commit")
    listed = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("commit_id").cast("string").alias("c")))).alias("l"))
    text = F.concat(F.lit(' -> \n"'), F.array_join(F.col("l.c"), BRANCH_SEP), F.lit('"'))
    return report.select("query_id").join(listed, "query_id").select("query_id", F.lit("CANDIDATE_COMMITS").alias("key"), text.alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Writes rows of ``LINES`` in order of (section, ord); sections are dealt
    by ranges, so none is split unless it outgrows a range, and then its parts
    are the neighbouring files' first and last sections."""
    spark: SparkSession = lines.sparkSession
    spark.dataSource.register(LineFiles)
    rows = lines.select(F.col("section").cast("string"), F.col("ord").cast("long"), F.col("line").cast("string"))
    ordered = rows.repartitionByRange("section", "ord").sortWithinPartitions("section", "ord")
    ordered.write.format(FORMAT).mode(mode).option("path", path).save()
