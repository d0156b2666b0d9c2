"""Queries for path discovery, touched commits, fallback hash tiers, branch
reachability, timestamps and selection (C1-C3, D1-D6, F2-F4, G1, H1, H2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.operators import cascade as CS
from blobtrail.operators import history as H
from blobtrail.operators import reachability as RC
from blobtrail.plans.oracle_views import blob_sql, with_views
from blobtrail.plans.registry import register
from blobtrail.session import written
from blobtrail.sources.testdata import Repo

PRIO_SQL = H.PRIORITY_BRANCH
PR_SQL = H.PR_BRANCH


# --- shared Spark pieces --------------------------------------------------------


def reach(repo: Repo) -> tuple[DataFrame, DataFrame]:
    """Chain cover and branch labels."""
    return repo.memo("reach", lambda: H.reach_labels(repo.refs(), repo.commit_parents()))


def branch_info(repo: Repo) -> DataFrame:
    return repo.memo("branch_info", lambda: written(H.labelled_branch_info(*reach(repo))))


def commit_attrs(repo: Repo) -> DataFrame:
    """(commit_id, ts, is_priority, branch) for every commit."""
    return repo.memo("attrs", lambda: written(H.commit_timestamp(repo.commits()).join(branch_info(repo), "commit_id", "left")))


def groups(repo: Repo, crlf: bool = False) -> DataFrame:
    q = CS.prepare_queries(repo.query_files(), crlf)
    return q.select("name", "blob_norm", "blob_raw", "text").dropDuplicates(["name", "blob_norm"])


def parts(repo: Repo) -> dict:
    return repo.memo("parts", lambda: CS.fallback_parts(groups(repo).drop("text"), repo.file_versions(), repo.changes(), repo.path_objects()))


# --- shared oracle pieces -------------------------------------------------------

def reach_sql() -> str:
    return (
        with_views("refs", "commit_parents").replace("WITH ", "WITH RECURSIVE ", 1)
        + """,
reach(branch, commit_id) AS (
  SELECT branch, tip_commit FROM refs
  UNION
  SELECT r.branch, p.parent_id FROM reach r JOIN commit_parents p ON p.commit_id = r.commit_id)"""
    )


NAMES_SQL = """
paths AS (SELECT path, min(ord) AS path_ord, regexp_extract(path, '[^/]*$') AS name FROM path_objects GROUP BY path),
names AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name FROM query_files),"""
# A (name, hint) stands for the name; the hint path comes before all others.
HINT_NAMES_SQL = """
opaths AS (SELECT path, min(ord) AS path_ord, regexp_extract(path, '[^/]*$') AS base FROM path_objects GROUP BY path),
keys AS (SELECT DISTINCT name, base, hint FROM hint_files),
paths AS (SELECT name, path, min(path_ord) AS path_ord FROM (
            SELECT name, hint AS path, -1000000000000 AS path_ord FROM keys WHERE hint IS NOT NULL
            UNION ALL SELECT k.name, o.path, o.path_ord FROM keys k JOIN opaths o ON o.base = k.base) GROUP BY 1, 2),
names AS (SELECT DISTINCT name FROM keys),"""
_TOUCHED_SQL = """
ren AS (SELECT path, old_path, log_ord FROM changes WHERE old_path IS NOT NULL AND old_path <> path),
walk(root, path, from_ord) AS (
  SELECT DISTINCT path, path, -4611686018427387904 FROM paths
  UNION
  SELECT w.root, r.old_path, r.log_ord FROM walk w JOIN ren r ON r.path = w.path AND r.log_ord > w.from_ord),
tch AS (SELECT path, commit_id, log_ord FROM changes UNION ALL SELECT old_path, commit_id, log_ord FROM changes WHERE old_path IS NOT NULL),
touch_all AS (
  SELECT p.name, c.commit_id, p.path_ord, c.log_ord,
         row_number() OVER (PARTITION BY p.name, c.commit_id ORDER BY p.path_ord, c.log_ord) AS rn
  FROM names n JOIN paths p ON p.name = n.name JOIN walk w ON w.root = p.path JOIN tch c ON c.path = w.path AND c.log_ord > w.from_ord),
touched AS (SELECT name, commit_id, path_ord, log_ord FROM touch_all WHERE rn = 1),
first_all AS (
  SELECT t.name, t.commit_id, fv.path, fv.blob_id, fv.content, t.path_ord AS t_path_ord, t.log_ord AS t_log_ord,
         row_number() OVER (PARTITION BY t.name, t.commit_id ORDER BY p.path_ord) AS rn
  FROM touched t JOIN paths p ON p.name = t.name JOIN file_versions fv ON fv.commit_id = t.commit_id AND fv.path = p.path),
first AS (SELECT name, commit_id, path, blob_id, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS content_lf,
                 t_path_ord, t_log_ord FROM first_all WHERE rn = 1)"""

PATHS_SQL = NAMES_SQL + _TOUCHED_SQL
HINT_PATHS_SQL = HINT_NAMES_SQL + _TOUCHED_SQL

QGROUPS_SQL = f"""
qg AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS name, {blob_sql("regexp_replace(content, '\\r\\n?', chr(10), 'g')")} AS blob_norm
       FROM query_files)"""


def repo_sql(*extra_views: str) -> str:
    views = with_views("file_versions", "changes", "path_objects", "query_files", *extra_views)
    return views.replace("WITH ", "WITH RECURSIVE ", 1) + "," + PATHS_SQL


# --- C1, C2, C3 -----------------------------------------------------------------


@register("discover_paths_by_filename", "C1", repo_sql() + "\nSELECT p.name, p.path, p.path_ord FROM names n JOIN paths p ON p.name = n.name")
def q_discover(repo: Repo) -> DataFrame:
    names = repo.query_files().select(H.basename(F.col("path")).alias("name"))
    return H.discover_paths(names, repo.path_objects()).select("name", "path", "path_ord")


@register(
    "candidate_paths",
    "C2",
    with_views("path_objects", "file_versions")
    + """,
paths AS (SELECT path, min(ord) AS path_ord, regexp_extract(path, '[^/]*$') AS name FROM path_objects GROUP BY path),
q AS (SELECT doc_id AS query_id, lang || '.txt' AS name, source || '/' || lang || '.txt' AS hint FROM documents),
c AS (SELECT query_id, hint AS path, 0 AS path_tier, 0 AS path_ord FROM q
      UNION ALL SELECT q.query_id, p.path, 1, p.path_ord FROM q JOIN paths p ON p.name = q.name),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY path_tier, path_ord) AS rn FROM c)
SELECT query_id, path, path_tier, path_ord FROM r WHERE rn = 1""",
)
def q_candidate_paths(repo: Repo) -> DataFrame:
    """Hint = the document's own repository path (so the hint also shows up
    among the discovered paths and the de-duplication keeps rank 0)."""
    d = repo.table("documents")
    q = d.select(
        F.col("doc_id").alias("query_id"),
        F.concat("lang", F.lit(".txt")).alias("path"),
        F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("hint"),
    )
    c = H.candidate_paths(q, repo.path_objects(), hint_col="hint")
    return c.select("query_id", "path", F.col("path_rank.tier").alias("path_tier"), F.col("path_rank.ord").alias("path_ord"))


@register(
    "valid_blob_id",
    "C3",
    with_views("file_versions")
    + ", b AS (SELECT commit_id, CASE WHEN commit_id % 9 = 0 THEN substr(blob_id, 1, 39) ELSE blob_id END AS raw_id FROM file_versions)"
    + "\nSELECT commit_id, CASE WHEN length(raw_id) = 40 THEN raw_id END AS blob_id FROM b",
)
def q_valid_blob_id(repo: Repo) -> DataFrame:
    """Ids as a resolver returns them; every ninth one comes back cut short."""
    fv = repo.file_versions()
    raw = F.when(F.col("commit_id") % 9 == 0, F.substring("blob_id", 1, 39)).otherwise(F.col("blob_id"))
    return fv.select("commit_id", H.valid_blob_id(raw).alias("blob_id"))


# --- D1, G1 ---------------------------------------------------------------------


@register(
    "exact_blob_match",
    "D1",
    with_views("file_versions", "changes", "query_files")
    + f""",
qb AS (SELECT DISTINCT {blob_sql("regexp_replace(content, '\\r\\n?', chr(10), 'g')")} AS blob_norm FROM query_files)
SELECT qb.blob_norm, c.commit_id, min(c.log_ord) AS log_ord FROM qb JOIN changes c ON c.blob_id = qb.blob_norm GROUP BY 1, 2""",
)
def q_exact(repo: Repo) -> DataFrame:
    hits = CS.exact_hits(groups(repo), repo.changes(), contains_only=False)
    return hits.select("blob_norm", "commit_id", F.col("o.r2").alias("log_ord"))


@register(
    "union_norm_raw",
    "G1",
    with_views("file_versions", "changes", "query_files")
    + f""",
q AS (SELECT DISTINCT {blob_sql('lf')} AS blob_norm, {blob_sql("replace(lf, chr(10), chr(13) || chr(10))")} AS blob_raw
      FROM (SELECT regexp_replace(content, '\\r\\n?', chr(10), 'g') AS lf FROM query_files)),
ids AS (SELECT blob_norm, blob_norm AS id, 0 AS src FROM q UNION ALL SELECT blob_norm, blob_raw, 1 FROM q WHERE blob_raw <> blob_norm),
h AS (SELECT ids.blob_norm, c.commit_id, ids.src, c.log_ord,
             row_number() OVER (PARTITION BY ids.blob_norm, c.commit_id ORDER BY ids.src, c.log_ord) AS rn
      FROM ids JOIN changes c ON c.blob_id = ids.id)
SELECT blob_norm, commit_id, src, log_ord FROM h WHERE rn = 1""",
)
def q_union_norm_raw(repo: Repo) -> DataFrame:
    hits = CS.exact_hits(groups(repo, crlf=True), repo.changes(), contains_only=False)
    return hits.select("blob_norm", "commit_id", F.col("o.r1").alias("src"), F.col("o.r2").alias("log_ord"))


# --- D2-D6 ----------------------------------------------------------------------


@register(
    "commits_touching_path",
    "D2",
    repo_sql()
    + """
SELECT w.root AS path, c.commit_id, min(c.log_ord) AS log_ord FROM walk w JOIN tch c ON c.path = w.path AND c.log_ord > w.from_ord GROUP BY 1, 2""",
)
def q_touching(repo: Repo) -> DataFrame:
    paths = repo.path_objects().select("path").distinct().withColumn("path_rank", F.lit(0)).withColumn("k", F.col("path"))
    t = H.commits_touching(paths, repo.changes(), key="k")
    return t.select(F.col("k").alias("path"), "commit_id", F.col("touch_ord.log_ord").alias("log_ord"))


@register("touched_versions", "D3", repo_sql() + "\nSELECT name, commit_id, path_ord, log_ord FROM touched")
def q_touched(repo: Repo) -> DataFrame:
    t = parts(repo)["touched"]
    return t.select("name", "commit_id", F.col("touch_ord.path_rank.ord").alias("path_ord"), F.col("touch_ord.log_ord").alias("log_ord"))


@register(
    "blob_first_match",
    "D4",
    repo_sql() + "," + QGROUPS_SQL + """
SELECT DISTINCT qg.name, qg.blob_norm, t.commit_id
FROM qg JOIN touched t ON t.name = qg.name JOIN paths p ON p.name = qg.name
JOIN file_versions fv ON fv.commit_id = t.commit_id AND fv.path = p.path AND fv.blob_id = qg.blob_norm""",
)
def q_blob_first(repo: Repo) -> DataFrame:
    return parts(repo)["d4"].select("name", "blob_norm", "commit_id").distinct()


@register("first_existing_version", "D5", repo_sql() + "\nSELECT name, commit_id, path, blob_id FROM first")
def q_first_existing(repo: Repo) -> DataFrame:
    return parts(repo)["first"].select("name", "commit_id", "path", "blob_id")


@register(
    "normalized_content_match",
    "D6",
    repo_sql() + "," + QGROUPS_SQL + f"""
SELECT qg.name, qg.blob_norm, f.commit_id FROM qg JOIN first f ON f.name = qg.name AND {blob_sql('f.content_lf')} = qg.blob_norm""",
)
def q_normalized_match(repo: Repo) -> DataFrame:
    return parts(repo)["d6"].select("name", "blob_norm", "commit_id").distinct()


# --- F2 -------------------------------------------------------------------------


@register("dedupe_preserve_order", "F2", "SELECT conv_id, sha1(text) AS digest, min(turn) AS first_turn FROM conversations GROUP BY 1, 2")
def q_dedupe(repo: Repo) -> DataFrame:
    """Versions of a conversation file (path = conv_id, commit = turn):
    each distinct text keeps its first turn."""
    c = repo.table("conversations")
    return c.groupBy("conv_id", F.sha1(F.encode("text", "UTF-8")).alias("digest")).agg(F.min("turn").alias("first_turn"))


# --- H1, H2, F3, F4 -------------------------------------------------------------


@register("branches_containing", "H1", reach_sql() + "\nSELECT branch, commit_id FROM reach")
def q_branches(repo: Repo) -> DataFrame:
    cover, labels = reach(repo)
    return RC.contained(labels, cover)


@register("branch_reach_sizes", "H1", reach_sql() + "\nSELECT branch, count(*) AS n_commits FROM reach GROUP BY branch")
def q_reach_sizes(repo: Repo) -> DataFrame:
    """Commits that each branch holds, from its label alone."""
    return RC.reach_sizes(reach(repo)[1])


@register(
    "commit_timestamp",
    "H2",
    with_views("commits") + "SELECT commit_id, coalesce(TRY_CAST(ts AS BIGINT), 0) AS ts FROM commits",
)
def q_timestamp(repo: Repo) -> DataFrame:
    return H.commit_timestamp(repo.commits())


def attrs_sql() -> str:
    return (
        reach_sql()
        + ","
        + with_views("commits")[len("WITH "):]
        + f""",
attrs AS (
  SELECT c.commit_id, coalesce(TRY_CAST(c.ts AS BIGINT), 0) AS ts,
         coalesce(bool_or(regexp_matches(r.branch, '{PRIO_SQL}')), false) AS prio
  FROM commits c LEFT JOIN reach r ON r.commit_id = c.commit_id GROUP BY c.commit_id, c.ts)"""
    )


def preferred_order_sql(o: str) -> str:
    """ORDER BY list of F3 for candidates with order expression(s) ``o``."""
    return f"CASE WHEN prio THEN 0 ELSE 1 END, CASE WHEN prio THEN ({o}) END, -ts, {o}"


@register(
    "choose_preferred",
    "F3",
    lambda: attrs_sql()
    + ","
    + with_views("file_versions", "changes")[len("WITH "):]
    + f""",
cand AS (SELECT blob_id, commit_id, min(log_ord) AS o FROM changes WHERE kind = 'add' GROUP BY 1, 2),
ranked AS (SELECT cand.blob_id, cand.commit_id, count(*) OVER (PARTITION BY cand.blob_id) AS n,
                  row_number() OVER (PARTITION BY cand.blob_id ORDER BY {preferred_order_sql('o')}) AS rn
           FROM cand JOIN attrs a ON a.commit_id = cand.commit_id)
SELECT blob_id, n AS n_candidates, commit_id AS preferred FROM ranked WHERE rn = 1""",
)
def q_choose_preferred(repo: Repo) -> DataFrame:
    """For every stored blob: the commits that add it (log order) and the
    preferred one among them."""
    ch = repo.changes().where(F.col("kind") == "add")
    cand = ch.groupBy("blob_id", "commit_id").agg(F.min("log_ord").alias("log_ord"))
    o = F.struct(F.lit(0.0).alias("neg_score"), F.lit(0).cast("long").alias("r1"), F.col("log_ord").cast("long").alias("r2"),
                 F.lit(0).cast("long").alias("r3"))
    hits = cand.select("blob_id", "commit_id", o.alias("o"))
    pref = CS.choose_preferred(hits, ["blob_id"], commit_attrs(repo).select("commit_id", "ts", "is_priority"))
    return pref.select("blob_id", F.col("n").alias("n_candidates"), "preferred")


@register(
    "choose_branch_for_commit",
    "F4",
    lambda: reach_sql()
    + f""",
cls AS (SELECT commit_id, branch, CASE WHEN regexp_matches(branch, '{PRIO_SQL}') THEN 0
                                       WHEN regexp_matches(branch, '{PR_SQL}') THEN 1 ELSE 2 END AS c FROM reach),
best AS (SELECT commit_id, branch, row_number() OVER (PARTITION BY commit_id ORDER BY c, branch) AS rn FROM cls)
SELECT d.doc_id AS commit_id, coalesce(b.branch, '') AS branch FROM documents d LEFT JOIN best b ON b.commit_id = d.doc_id AND b.rn = 1""",
)
def q_branch_for_commit(repo: Repo) -> DataFrame:
    d = repo.table("documents").select(F.col("doc_id").alias("commit_id"))
    return d.join(branch_info(repo).select("commit_id", "branch"), "commit_id", "left").select(
        "commit_id", F.coalesce("branch", F.lit("")).alias("branch")
    )
