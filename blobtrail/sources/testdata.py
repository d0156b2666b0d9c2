"""The provenance tables, derived with DataFrame code from the driver's
parquet tables (``documents``, ``pages``, ``events``, ``conversations``,
``benchmark``), so that every job grows with the input.

Derivation (each document is one commit of a synthetic repository):

* ``file_versions``: commit = doc_id, path = source/lang.txt, content =
  text, stored with CRLF line ends when doc_id % 7 = 3 (so line-end
  normalisation has work to do), log order newest first.
* ``query_files``: every document is also a file to look up: query_id =
  doc_id, path = lang.txt; its own commit is excluded from its matches.
* ``commits``: ts = 1700000000 + (doc_id * 7919) % 100000 (no ties), the
  text "notint" (parsed as 0) when doc_id % 97 = 5.
* ``commit_parents``: one chain per source (doc_id -> doc_id - 20) plus
  merges doc_id -> doc_id - 1 when doc_id % 100 = 0.
* ``changes``: an add row per version, as a rename of the chain parent's path
  when doc_id % 97 = 4 and the paths differ; a remove row of the chain
  parent's blob when it differs.
* ``refs``: tip = newest commit per source; branch name by source.
* ``trees``: whole snapshots. A commit's text is a new file of its chain that
  stays for TREE_AGE commits and is edited at the age TREE_EDIT_AGE; all files
  move to another directory every TREE_MOVE commits; every fifth file has a
  copy whose name depends on the directory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.functions.content import blob_id

# --- fixed values of the synthetic repository ------------------------------
TS_BASE = 1700000000
TS_STEP = 7919
TS_MOD = 100000
CHAIN_STEP = 20
MERGE_EVERY = 100
RENAME_MOD, RENAME_REM = 97, 4
CRLF_MOD, CRLF_REM = 7, 3
BAD_TS_MOD, BAD_TS_REM = 97, 5
TREE_AGE, TREE_EDIT_AGE, TREE_MOVE, TREE_DIRS, TREE_COPY = 4, 2, 6, 3, 5
TREE_EDIT = "\nreviewed once more\n"
BRANCH_BY_SOURCE = {
    "src0": "origin/main",
    "src1": "origin/release/1.2",
    "src2": "origin/pr/7/head",
    "src3": "origin/2.10",
}
FEATURE_PREFIX = "origin/feature/"
# ---------------------------------------------------------------------------

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@dataclass
class Repo:
    """Lazily built DataFrames over one scale-factor directory."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.memo(f"table {name}", lambda: self._read(name))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table for jobs that spend much time per row: dealt out by ``key``
        where its files give fewer scan tasks than there are cores (the
        driver's small tables are one row group), as it is otherwise."""
        df = self.table(name)
        few = df.rdd.getNumPartitions() < self.spark.sparkContext.defaultParallelism
        return df.repartition(key) if few else df

    def memo(self, name: str, build: Callable[[], Any]) -> Any:
        """Derived tables that several queries share."""
        if name not in self._cache:
            self._cache[name] = build()
        return self._cache[name]

    # -- repository views -------------------------------------------------
    def file_versions(self) -> DataFrame:
        d = self.table("documents")
        content = F.when(F.col("doc_id") % CRLF_MOD == CRLF_REM, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(
            F.col("text")
        )
        return d.select(
            F.col("doc_id").alias("commit_id"),
            F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("path"),
            content.alias("content"),
            (-F.col("doc_id")).alias("log_ord"),
        ).withColumn("blob_id", blob_id(F.col("content")))

    def query_files(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            F.col("doc_id").alias("query_id"),
            F.concat("lang", F.lit(".txt")).alias("path"),
            F.col("text").alias("content"),
            F.col("doc_id").alias("self_commit"),
        )

    def hint_files(self) -> DataFrame:
        """``query_files`` with hint paths: by doc_id % 3 the document's own
        path, one of another name, or none; every fifth file has no name."""
        d = self.table("documents")
        other = F.concat("source", F.lit("/"), F.when(F.col("lang") == "en", "de").otherwise("en"), F.lit(".txt"))
        own = F.concat("source", F.lit("/"), "lang", F.lit(".txt"))
        return d.select(
            F.col("doc_id").alias("query_id"),
            F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat("lang", F.lit(".txt"))).alias("path"),
            F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, other).alias("hint"),
            F.col("text").alias("content"),
            F.col("doc_id").alias("self_commit"),
        )

    def commits(self) -> DataFrame:
        d = self.table("documents")
        ts = (F.lit(TS_BASE) + (F.col("doc_id") * TS_STEP) % TS_MOD).cast("string")
        ts = F.when(F.col("doc_id") % BAD_TS_MOD == BAD_TS_REM, F.lit("notint")).otherwise(ts)
        return d.select(F.col("doc_id").alias("commit_id"), ts.alias("ts"))

    def commit_parents(self) -> DataFrame:
        d = self.table("documents").select("doc_id")
        chain = d.where(F.col("doc_id") >= CHAIN_STEP).select(
            F.col("doc_id").alias("commit_id"), (F.col("doc_id") - CHAIN_STEP).alias("parent_id")
        )
        merges = d.where((F.col("doc_id") > 0) & (F.col("doc_id") % MERGE_EVERY == 0)).select(
            F.col("doc_id").alias("commit_id"), (F.col("doc_id") - 1).alias("parent_id")
        )
        return chain.unionByName(merges)

    def changes(self) -> DataFrame:
        fv = self.file_versions().select("commit_id", "path", "blob_id", "log_ord")
        before = fv.select((F.col("commit_id") + CHAIN_STEP).alias("commit_id"), F.col("path").alias("p_path"))
        renamed = (F.col("commit_id") % RENAME_MOD == RENAME_REM) & (F.col("p_path") != F.col("path"))
        adds = fv.join(before, "commit_id", "left").select(
            "commit_id", "path", F.when(renamed, F.col("p_path")).alias("old_path"), "blob_id",
            F.lit("add").alias("kind"), "log_ord",
        )
        parent = fv.select(
            F.col("commit_id").alias("p_commit"), F.col("path").alias("p_path"), F.col("blob_id").alias("p_blob")
        )
        child = fv.where(F.col("commit_id") >= CHAIN_STEP)
        removes = (
            child.join(parent, child.commit_id - CHAIN_STEP == parent.p_commit)
            .where(F.col("p_blob") != F.col("blob_id"))
            .select(
                "commit_id", F.col("p_path").alias("path"), F.lit(None).cast("string").alias("old_path"),
                F.col("p_blob").alias("blob_id"), F.lit("remove").alias("kind"), "log_ord",
            )
        )
        return adds.unionByName(removes)

    def trees(self) -> DataFrame:
        """(commit_id, path, blob_id, content): every file of every commit."""
        d = self.table("documents").select("doc_id", "text")
        at = lambda df: df.withColumn("commit_id", F.col("doc_id") + CHAIN_STEP * F.col("age"))
        # Ages are settled from ids alone, so a text is moved once, not once an age.
        ids = d.select("doc_id").distinct()
        ages = at(ids.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(TREE_AGE - 1))).alias("age")))
        ages = ages.join(ids.withColumnRenamed("doc_id", "commit_id"), "commit_id", "left_semi").groupBy("doc_id").agg(F.collect_list("age").alias("ages"))
        alive = at(d.join(ages, "doc_id").select("doc_id", "text", F.explode("ages").alias("age")))
        slot = F.floor(F.col("doc_id") / CHAIN_STEP) % TREE_AGE
        folder = F.floor(F.floor(F.col("commit_id") / CHAIN_STEP) / TREE_MOVE) % TREE_DIRS
        below = F.concat(F.lit("r"), (F.col("doc_id") % CHAIN_STEP).cast("string"), F.lit("/d"), folder.cast("string"), F.lit("/"))
        names = F.array(
            F.concat(below, F.lit("slot"), slot.cast("string"), F.lit(".txt")),
            F.when(F.col("doc_id") % TREE_COPY == 0, F.concat(below, F.lit("copy"), ((slot + folder) % TREE_AGE).cast("string"), F.lit(".txt"))),
        )
        content = F.when(F.col("age") >= TREE_EDIT_AGE, F.concat("text", F.lit(TREE_EDIT))).otherwise(F.col("text"))
        named = alive.select("commit_id", F.explode(F.array_compact(names)).alias("path"), content.alias("content"))
        return named.withColumn("blob_id", blob_id(F.col("content")))

    def path_objects(self) -> DataFrame:
        """Every (blob, path) object with its first-seen order."""
        fv = self.file_versions()
        return fv.select("blob_id", "path", F.col("log_ord").alias("ord"))

    def refs(self) -> DataFrame:
        d = self.table("documents")
        tips = d.groupBy("source").agg(F.max("doc_id").alias("tip_commit"))
        return tips.select(branch_name(F.col("source")).alias("branch"), "tip_commit")


def branch_name(source: Column) -> Column:
    expr = F.concat(F.lit(FEATURE_PREFIX), source)
    for src, name in reversed(list(BRANCH_BY_SOURCE.items())):
        expr = F.when(source == src, F.lit(name)).otherwise(expr)
    return expr


# --- fork catalog and run metrics views ------------------------------------
# Each `pages` row stands for one fork. Every third page is a fork of "org0/proj",
# the hot target, by turns in the repo's own list (src "repo") and its
# parent's. The others, in blocks of FORK_BLOCK pages, list the forks of one
# target "org<block + 1>/proj", two thirds of them in the repo's list; so
# targets and lists grow with the data. The place in a list follows from the
# page_id, so pages of 100 forks need no window. Some records lack fields,
# some pages but the hot target's are malformed or not a list, by fixed rules.
FORK_BLOCK, FORK_HOT = 720, 3
FORK_PER_PAGE = 100
MALFORMED_BODY = '[{"full_name": "broken'
NOT_LIST_BODY = '{"message": "Not Found"}'


def host_label(url: Column) -> Column:
    """First label of the URL's host name."""
    return F.regexp_extract(url, r"^[a-z]+://([^./:]+)", 1)


def _fork_fields(d: DataFrame) -> DataFrame:
    pid = F.col("page_id")
    host = host_label(F.col("url"))
    full = F.concat(host, F.lit("/r"), (pid % 40).cast("string"))
    hot, turn = pid % FORK_HOT == 0, F.floor(pid / FORK_HOT)
    place = F.floor((pid % FORK_BLOCK) / FORK_HOT) * (FORK_HOT - 1) + pid % FORK_HOT - 1  # among the block's other pages
    own = FORK_BLOCK * (FORK_HOT - 1) // FORK_HOT * 2 // 3  # of them in the repo's list
    return d.select(
        F.concat(F.lit("org"), F.when(hot, 0).otherwise(F.floor(pid / FORK_BLOCK) + 1).cast("string"), F.lit("/proj")).alias("target"),
        F.when(F.when(hot, turn % 2 == 0).otherwise(place < own), F.lit("repo")).otherwise(F.lit("parent")).alias("src"),
        F.when(hot, F.floor(turn / 2)).when(place < own, place).otherwise(place - own).cast("int").alias("ord0"),
        F.struct(
            F.when(pid % 17 == 0, F.lit("")).otherwise(full).alias("full_name"),
            F.when(pid % 13 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("r"), (pid % 40).cast("string"))).alias("name"),
            F.struct(F.when(pid % 11 == 0, F.lit("")).otherwise(host).alias("login")).alias("owner"),
            F.when(pid % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("https://github.com/"), full, F.lit(".git"))).alias("clone_url"),
            F.when(pid % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("git@github.com:"), full, F.lit(".git"))).alias("ssh_url"),
            F.when(pid % 15 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("git://github.com/"), full, F.lit(".git"))).alias("git_url"),
        ).alias("rec"),
    )


def fork_pages(repo: Repo) -> DataFrame:
    f = _fork_fields(repo.table("pages"))
    f = f.withColumn("page", (F.floor(F.col("ord0") / FORK_PER_PAGE) + 1).cast("int")).withColumn(
        "pos", F.col("ord0") % FORK_PER_PAGE
    )
    pages = f.groupBy("target", "src", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "rec"))).alias("items"))
    t = F.regexp_extract("target", "^org([0-9]+)", 1).cast("int")
    s = F.when(F.col("src") == "repo", 0).otherwise(1)
    body = (
        F.when((t > 0) & ((t + F.col("page")) % 4 == 3), F.lit(MALFORMED_BODY))
        .when((t > 0) & ((t + s + F.col("page")) % 5 == 4), F.lit(NOT_LIST_BODY))
        .otherwise(F.to_json(F.transform("items", lambda x: x["rec"])))
    )
    return pages.select("target", "src", "page", body.alias("body"))


def fork_targets(repo: Repo) -> int:
    """Number of targets that the pages list forks of."""
    last = repo.table("pages").agg(F.max("page_id")).first()[0]
    return 1 if last is None else last // FORK_BLOCK + 2


def repo_urls(repo: Repo) -> DataFrame:
    """Catalog of repository URLs: each page's own URL, plus a GitHub URL in
    https, scp or ssh form by page_id % 3."""
    p = repo.table("pages")
    pid = F.col("page_id")
    path = F.concat(host_label(F.col("url")), F.lit("/r"), (pid % 40).cast("string"))
    gh = (
        F.when(pid % 3 == 0, F.concat(F.lit("https://github.com/"), path, F.lit(".git")))
        .when(pid % 3 == 1, F.concat(F.lit("git@github.com:"), path, F.lit(".git")))
        .otherwise(F.concat(F.lit("ssh://git@GitHub.com/"), path, F.lit("/")))
    )
    return p.select((pid * 2).alias("id"), F.col("url")).unionByName(p.select((pid * 2 + 1).alias("id"), gh.alias("url")))


def repo_records(repo: Repo) -> DataFrame:
    """Repository records (as the API would return them) built from pages:
    every other one is a fork; parent fields are dropped by fixed rules."""
    p = repo.table("pages")
    pid = F.col("page_id")
    host = host_label(F.col("url"))
    full = F.concat(host, F.lit("/r"), (pid % 40).cast("string"))
    rec = F.struct(
        (pid % 2 == 0).alias("fork"),
        F.struct(
            F.when(pid % 3 == 0, F.lit("")).otherwise(full).alias("full_name"),
            F.concat(F.lit("r"), (pid % 40).cast("string")).alias("name"),
            F.struct(host.alias("login")).alias("owner"),
            F.when(pid % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("https://github.com/"), full, F.lit(".git"))).alias("clone_url"),
            F.when(pid % 8 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("git@github.com:"), full, F.lit(".git"))).alias("ssh_url"),
            F.lit(None).cast("string").alias("git_url"),
        ).alias("parent"),
    )
    return p.select(pid.alias("repo_id"), F.to_json(rec).alias("body"))


def step_events(repo: Repo) -> DataFrame:
    """Run metrics events: run = user, step = event type, duration in ms =
    value * 1000 scaled by event_id % 200 (so minutes and hours occur)."""
    e = repo.table("events")
    ms = (F.col("value") * 1000).cast("long") * (F.col("event_id") % 200)
    start = F.col("ts").cast("timestamp")
    return e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("step"),
        start.alias("start_ts"),
        F.timestamp_micros(F.unix_micros(start) + ms * 1000).alias("end_ts"),
    )
