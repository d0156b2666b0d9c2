"""Queries on whole trees (D2 on snapshots): changes between a commit and its
parents, renames found among them, and touched commits that follow these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.operators import history as H
from blobtrail.operators import snapshots as SN
from blobtrail.plans import sqlfrag as S
from blobtrail.plans.oracle_views import with_views
from blobtrail.plans.registry import register
from blobtrail.session import written
from blobtrail.sources.testdata import Repo

K = 5

DIFF_SQL = """
edges AS (SELECT commit_id, parent_id FROM commit_parents
          UNION ALL SELECT DISTINCT commit_id, CAST(NULL AS BIGINT) FROM trees WHERE commit_id NOT IN (SELECT commit_id FROM commit_parents)),
new_side AS (SELECT e.commit_id, e.parent_id, t.path, t.blob_id FROM edges e JOIN trees t ON t.commit_id = e.commit_id),
old_side AS (SELECT e.commit_id, e.parent_id, t.path, t.blob_id FROM edges e JOIN trees t ON t.commit_id = e.parent_id),
diff AS (
  SELECT coalesce(n.commit_id, o.commit_id) AS commit_id, coalesce(n.parent_id, o.parent_id) AS parent_id, coalesce(n.path, o.path) AS path,
         CASE WHEN o.path IS NULL THEN 'add' WHEN n.path IS NULL THEN 'remove' ELSE 'modify' END AS kind, o.blob_id AS old_blob, n.blob_id AS blob_id
  FROM new_side n FULL OUTER JOIN old_side o ON n.commit_id = o.commit_id AND n.parent_id IS NOT DISTINCT FROM o.parent_id AND n.path = o.path
  WHERE n.path IS NULL OR o.path IS NULL OR n.blob_id IS DISTINCT FROM o.blob_id)"""


def _shown(kind: str, path: str, blob: str) -> str:
    return f"SELECT coalesce(commit_id || '>' || coalesce(parent_id::VARCHAR, ''), '') AS edge, path AS {path}, {blob} AS blob, regexp_extract(path, '[^/]*$') AS name FROM diff WHERE kind = '{kind}'"


RENAMES_SQL = f"""
r0 AS ({_shown('remove', 'old_path', 'old_blob')}),
a0 AS ({_shown('add', 'path', 'blob_id')}),
m1 AS (SELECT r.edge, r.old_path, a.path, r.blob AS old_blob, a.blob AS blob_id, 1.0::DOUBLE AS score, 'same_name' AS how
       FROM (SELECT *, row_number() OVER (PARTITION BY edge, blob, name ORDER BY old_path) AS k FROM r0) r
       JOIN (SELECT *, row_number() OVER (PARTITION BY edge, blob, name ORDER BY path) AS k FROM a0) a USING (edge, blob, name, k)),
r1 AS (SELECT r0.* FROM r0 ANTI JOIN m1 USING (edge, old_path)),
a1 AS (SELECT a0.* FROM a0 ANTI JOIN m1 USING (edge, path)),
m2 AS (SELECT r.edge, r.old_path, a.path, r.blob AS old_blob, a.blob AS blob_id, 1.0::DOUBLE AS score, 'same_blob' AS how
       FROM (SELECT *, row_number() OVER (PARTITION BY edge, blob ORDER BY old_path) AS k FROM r1) r
       JOIN (SELECT *, row_number() OVER (PARTITION BY edge, blob ORDER BY path) AS k FROM a1) a USING (edge, blob, k)),
r2 AS (SELECT r1.* FROM r1 ANTI JOIN m2 USING (edge, old_path)),
a2 AS (SELECT a1.* FROM a1 ANTI JOIN m2 USING (edge, path)),
bs AS (SELECT b.blob_id, any_value(content) AS content FROM trees b WHERE blob_id IN (SELECT blob FROM r2 UNION SELECT blob FROM a2) GROUP BY 1),
fs AS (SELECT blob_id, {S.SET_EXPR["jaccard"](K, 0, 0)} AS s FROM {S.features('blob_id', 'content', 'bs', K)}),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY edge ORDER BY score DESC, old_path, path) AS rn FROM (
    SELECT r.edge, r.old_path, a.path, r.blob AS old_blob, a.blob AS blob_id,
           CASE WHEN len(x.s) = 0 AND len(y.s) = 0 THEN 1.0 ELSE len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) END AS score
    FROM r2 r JOIN a2 a ON a.edge = r.edge JOIN fs x ON x.blob_id = r.blob JOIN fs y ON y.blob_id = a.blob) WHERE score >= {SN.RENAME_SCORE}),
greedy(edge, rn, olds, news) AS (
  SELECT edge, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM (SELECT DISTINCT edge FROM cand)
  UNION ALL
  SELECT edge, rn, olds, news FROM (
    SELECT g.edge, c.rn, list_append(g.olds, c.old_path) AS olds, list_append(g.news, c.path) AS news,
           row_number() OVER (PARTITION BY g.edge ORDER BY c.rn) AS k
    FROM greedy g JOIN cand c ON c.edge = g.edge AND NOT list_contains(g.olds, c.old_path) AND NOT list_contains(g.news, c.path)) WHERE k = 1),
renamed AS (
  SELECT * FROM m1 UNION ALL SELECT * FROM m2
  UNION ALL SELECT c.edge, c.old_path, c.path, c.old_blob, c.blob_id, c.score, 'similar' FROM cand c JOIN greedy g ON g.edge = c.edge AND g.rn = c.rn),
renames AS (SELECT d.commit_id, d.parent_id, r.old_path, r.path, r.old_blob, r.blob_id, r.score, r.how
            FROM renamed r JOIN diff d ON d.kind = 'add' AND d.path = r.path AND coalesce(d.commit_id || '>' || coalesce(d.parent_id::VARCHAR, ''), '') = r.edge)"""


def _views() -> str:
    return with_views("trees", "commit_parents").replace("WITH ", "WITH RECURSIVE ", 1) + "," + DIFF_SQL


def diff(repo: Repo) -> DataFrame:
    return repo.memo("tree diff", lambda: written(SN.tree_changes(repo.trees(), repo.commit_parents())))


def renames(repo: Repo) -> DataFrame:
    return repo.memo("renames", lambda: written(SN.find_renames(diff(repo), repo.trees(), shingle_size=K)))


@register("tree_changes", "D2", _views() + "\nSELECT * FROM diff")
def q_tree_changes(repo: Repo) -> DataFrame:
    """What every commit adds, removes and modifies against each parent."""
    return diff(repo)


@register(
    "find_renames",
    "D2",
    _views() + "," + RENAMES_SQL + "\nSELECT commit_id, parent_id, old_path, path, old_blob, blob_id, round(score, 6) AS score, how FROM renames",
)
def q_find_renames(repo: Repo) -> DataFrame:
    """Renames that no table states: equal contents, then similar ones."""
    return renames(repo).withColumn("score", F.round("score", 6))


@register(
    "commits_following_found_renames",
    "D2",
    _views()
    + ","
    + RENAMES_SQL
    + """,
ch AS (SELECT commit_id, path, -commit_id AS log_ord FROM diff),
ren AS (SELECT DISTINCT path, old_path, -commit_id AS log_ord FROM renames WHERE old_path <> path),
walk(root, path, from_ord) AS (
  SELECT DISTINCT path, path, -4611686018427387904 FROM trees
  UNION
  SELECT w.root, r.old_path, r.log_ord FROM walk w JOIN ren r ON r.path = w.path AND r.log_ord > w.from_ord),
tch AS (SELECT path, commit_id, log_ord FROM ch UNION ALL SELECT old_path, -log_ord, log_ord FROM ren)
SELECT w.root AS path, c.commit_id, min(c.log_ord) AS log_ord FROM walk w JOIN tch c ON c.path = w.path AND c.log_ord > w.from_ord GROUP BY 1, 2""",
)
def q_following(repo: Repo) -> DataFrame:
    """Commits that touched each path of any tree, followed through the
    renames found."""
    log = repo.commits().select("commit_id", (-F.col("commit_id")).alias("log_ord"))
    changes = written(SN.as_changes(diff(repo), renames(repo), log))
    paths = repo.trees().select("path").distinct().withColumn("path_rank", F.lit(0)).withColumn("k", F.col("path"))
    t = H.commits_touching(paths, changes, key="k")
    return t.select(F.col("k").alias("path"), "commit_id", F.col("touch_ord.log_ord").alias("log_ord"))
