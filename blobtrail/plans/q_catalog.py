"""Queries for the fork catalog (A3, C5, F5, F6, G2, G3), repository URL
parsing (B13) and run metrics (B14, B15, E9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.functions import text_format as TF
from blobtrail.operators import forks as FK
from blobtrail.operators.metrics import step_metrics
from blobtrail.plans.registry import register
from blobtrail.sources import testdata as TD
from blobtrail.sources.testdata import Repo

OFFSET, LIMIT = 10, 20
EXISTING_FIRST = 3  # forks at positions 1..3 were fetched by an earlier run

# --- shared Spark pieces -----------------------------------------------------------


def _forks(repo: Repo) -> DataFrame:
    return FK.read_fork_pages(TD.fork_pages(repo))


def combined_forks(repo: Repo) -> DataFrame:
    return FK.union_forks(_forks(repo))


def _target_repo() -> F.Column:
    return F.element_at(F.split(F.col("target"), "/"), -1)


def _usable(repo: Repo, combined: DataFrame) -> DataFrame:
    return FK.usable_forks(combined, _target_repo())


# --- oracle pieces -----------------------------------------------------------------

B, OWN = TD.FORK_BLOCK, 320  # of a block's 480 pages beside the hot target's
_HOST = "regexp_extract(url, '^[a-z]+://([^./:]+)', 1)"
FORKS_SQL = f"""
WITH f AS (
  SELECT 'org' || CASE WHEN hot THEN 0 ELSE page_id // {B} + 1 END || '/proj' AS target,
         CASE WHEN hot THEN CASE WHEN page_id // 3 % 2 = 0 THEN 'repo' ELSE 'parent' END WHEN place < {OWN} THEN 'repo' ELSE 'parent' END AS src,
         CAST(CASE WHEN hot THEN page_id // 6 WHEN place < {OWN} THEN place ELSE place - {OWN} END AS INTEGER) AS ord0, {_HOST} AS host, page_id
  FROM (SELECT *, page_id % 3 = 0 AS hot, page_id % {B} // 3 * 2 + page_id % 3 - 1 AS place FROM pages)),
r AS (SELECT target, src, ord0 // 100 + 1 AS page, ord0 % 100 AS pos,
        CASE WHEN page_id % 17 = 0 THEN '' ELSE host || '/r' || (page_id % 40) END AS full_name,
        CASE WHEN page_id % 13 = 0 THEN NULL ELSE 'r' || (page_id % 40) END AS name,
        CASE WHEN page_id % 11 = 0 THEN '' ELSE host END AS login,
        CASE WHEN page_id % 5 = 0 THEN '' ELSE 'https://github.com/' || host || '/r' || (page_id % 40) || '.git' END AS clone_url,
        CASE WHEN page_id % 10 = 0 THEN NULL ELSE 'git@github.com:' || host || '/r' || (page_id % 40) || '.git' END AS ssh_url,
        CASE WHEN page_id % 15 = 0 THEN NULL ELSE 'git://github.com/' || host || '/r' || (page_id % 40) || '.git' END AS git_url
      FROM f),
pg AS (SELECT target, src, page, count(*) AS n,
         target <> 'org0/proj' AND (((CAST(regexp_extract(target, '^org([0-9]+)', 1) AS INTEGER) + page) % 4 = 3)
         OR ((CAST(regexp_extract(target, '^org([0-9]+)', 1) AS INTEGER) + CASE WHEN src = 'repo' THEN 0 ELSE 1 END + page) % 5 = 4)) AS bad
       FROM r GROUP BY 1, 2, 3),
stop AS (SELECT target, src, least(coalesce(min(page) FILTER (WHERE bad) - 1, 1 << 30),
                                   coalesce(min(page) FILTER (WHERE NOT bad AND n < 100), 1 << 30)) AS last_page
         FROM pg GROUP BY 1, 2),
forks AS (SELECT r.*, (r.page - 1) * 100 + r.pos + 1 AS ordinal FROM r JOIN stop s ON s.target = r.target AND s.src = r.src
          WHERE r.page <= s.last_page),
firsts AS (SELECT *, row_number() OVER (PARTITION BY target, full_name ORDER BY CASE WHEN src = 'repo' THEN 0 ELSE 1 END, ordinal) AS rk
           FROM forks WHERE full_name IS NOT NULL AND full_name <> ''),
combined AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY CASE WHEN src = 'repo' THEN 0 ELSE 1 END, ordinal) AS cpos
             FROM firsts WHERE rk = 1),
sel AS (SELECT * FROM combined WHERE cpos > {OFFSET} AND cpos <= {OFFSET + LIMIT}),
usable AS (SELECT target, cpos AS pos, coalesce(nullif(login, ''), 'fork') AS owner_login,
                  coalesce(nullif(name, ''), 'proj') AS repo_name,
                  coalesce(nullif(clone_url, ''), nullif(ssh_url, ''), nullif(git_url, '')) AS clone_url
           FROM sel WHERE coalesce(nullif(clone_url, ''), nullif(ssh_url, ''), nullif(git_url, '')) IS NOT NULL)"""


def _sanitize_sql(s: str) -> str:
    return f"substr(regexp_replace(regexp_replace({s}, '[^A-Za-z0-9_.-]', '_', 'g'), '^\\.', '_'), 1, 200)"


# --- A3, G2, F5, C5, F6 -------------------------------------------------------------


@register("read_fork_pages", "A3", FORKS_SQL + "\nSELECT target, src, ordinal, full_name FROM forks")
def q_read_fork_pages(repo: Repo) -> DataFrame:
    return _forks(repo).select("target", "src", "ordinal", F.col("fork.full_name").alias("full_name"))


@register("union_forks", "G2", FORKS_SQL + "\nSELECT target, cpos AS pos, full_name FROM combined")
def q_union_forks(repo: Repo) -> DataFrame:
    return combined_forks(repo).select("target", "pos", F.col("fork.full_name").alias("full_name"))


@register("fork_window", "F5", FORKS_SQL + "\nSELECT target, cpos AS pos, full_name FROM sel")
def q_fork_window(repo: Repo) -> DataFrame:
    sel = FK.fork_window(combined_forks(repo), OFFSET, LIMIT)
    return sel.select("target", "pos", F.col("fork.full_name").alias("full_name"))


@register("usable_forks", "C5", FORKS_SQL + "\nSELECT target, pos, owner_login, repo_name, clone_url FROM usable")
def q_usable(repo: Repo) -> DataFrame:
    sel = FK.fork_window(combined_forks(repo), OFFSET, LIMIT)
    return _usable(repo, sel).select("target", "pos", "owner_login", "repo_name", "clone_url")


_F6_SQL = (
    FORKS_SQL.replace("WITH f AS", "WITH RECURSIVE f AS", 1)
    + f""",
prev AS (SELECT target, {_sanitize_sql("'fork_' || coalesce(nullif(login, ''), 'fork') || '_' || coalesce(nullif(name, ''), 'proj')")} AS remote
         FROM combined WHERE cpos <= {EXISTING_FIRST}),
ex AS (SELECT t.target, list_distinct(['origin'] || coalesce(list(p.remote) FILTER (WHERE p.remote IS NOT NULL), [])) AS used0
       FROM (SELECT DISTINCT target FROM usable) t LEFT JOIN prev p ON p.target = t.target GROUP BY t.target),
it AS (SELECT target, pos, {_sanitize_sql("'fork_' || owner_login || '_' || repo_name")} AS base,
              row_number() OVER (PARTITION BY target ORDER BY pos) AS k FROM usable),
fold(target, k, used, pos, remote) AS (
  SELECT target, 0, used0, NULL::BIGINT, NULL::VARCHAR FROM ex
  UNION ALL
  SELECT fo.target, fo.k + 1, list_append(fo.used, nm), it.pos, nm
  FROM fold fo JOIN it ON it.target = fo.target AND it.k = fo.k + 1,
  LATERAL (SELECT list_filter(list_transform(range(0, len(fo.used) + 2),
                  lambda i: CASE WHEN i = 0 THEN it.base ELSE substr(it.base || '_' || i, 1, 200) END),
                  lambda c: NOT list_contains(fo.used, c))[1] AS nm))
SELECT u.target, u.pos, u.owner_login, u.repo_name, fo.remote FROM usable u JOIN fold fo ON fo.target = u.target AND fo.pos = u.pos"""
)


@register("unique_remote_names", "F6", _F6_SQL)
def q_remote_names(repo: Repo) -> DataFrame:
    comb = combined_forks(repo)
    sel = FK.fork_window(comb, OFFSET, LIMIT)
    usable = _usable(repo, sel)
    prev = _usable(repo, comb.where(F.col("pos") <= EXISTING_FIRST))
    prev_names = prev.select(
        "target", TF.sanitize_remote_name(F.concat(F.lit("fork_"), "owner_login", F.lit("_"), "repo_name")).alias("remote")
    )
    existing = usable.select("target").distinct().withColumn("remote", F.lit("origin")).unionByName(prev_names)
    named = FK.unique_remote_names(usable, existing)
    return named.select("target", "pos", "owner_login", "repo_name", "remote")


@register(
    "upstream_of_fork",
    "G3",
    f"""WITH p AS (
  SELECT page_id AS repo_id, page_id % 2 = 0 AS is_fork, {_HOST} AS host, page_id FROM pages),
q AS (SELECT repo_id, is_fork, CASE WHEN page_id % 3 = 0 THEN '' ELSE host || '/r' || (page_id % 40) END AS fname,
             host AS login, 'r' || (page_id % 40) AS name,
             coalesce(nullif(CASE WHEN page_id % 4 = 0 THEN '' ELSE 'https://github.com/' || host || '/r' || (page_id % 40) || '.git' END, ''),
                      nullif(CASE WHEN page_id % 8 = 0 THEN NULL ELSE 'git@github.com:' || host || '/r' || (page_id % 40) || '.git' END, '')) AS url
      FROM p),
o AS (SELECT repo_id, is_fork, url,
             CASE WHEN position('/' IN fname) > 0 THEN split_part(fname, '/', 1) ELSE login END AS owner,
             CASE WHEN position('/' IN fname) > 0 THEN substr(fname, position('/' IN fname) + 1) ELSE name END AS repo
      FROM q)
SELECT repo_id, is_fork, CASE WHEN is_fork THEN owner END AS parent_owner, CASE WHEN is_fork THEN repo END AS parent_repo,
       CASE WHEN is_fork THEN url END AS parent_url,
       CASE WHEN is_fork AND nullif(owner, '') IS NOT NULL AND nullif(repo, '') IS NOT NULL AND url IS NOT NULL
            THEN {_sanitize_sql("'upstream_' || owner || '_' || repo")} END AS upstream_remote
FROM o""",
)
def q_upstream(repo: Repo) -> DataFrame:
    recs = TD.repo_records(repo).select("repo_id", F.from_json("body", FK.REPO_SCHEMA).alias("record"))
    return FK.upstream_of_fork(recs)


# --- B13 --------------------------------------------------------------------------

_GH = TF.GITHUB_URL.replace("'", "''")


@register(
    "repo_catalog",
    "B13",
    f"""WITH u AS (
  SELECT page_id * 2 AS id, url FROM pages
  UNION ALL
  SELECT page_id * 2 + 1, CASE page_id % 3
      WHEN 0 THEN 'https://github.com/' || {_HOST} || '/r' || (page_id % 40) || '.git'
      WHEN 1 THEN 'git@github.com:' || {_HOST} || '/r' || (page_id % 40) || '.git'
      ELSE 'ssh://git@GitHub.com/' || {_HOST} || '/r' || (page_id % 40) || '/' END FROM pages),
p AS (SELECT id, url, CASE WHEN regexp_matches(trim(url), '{_GH}') THEN regexp_extract(trim(url), '{_GH}', 1) END AS owner,
             CASE WHEN regexp_matches(trim(url), '{_GH}') THEN regexp_extract(trim(url), '{_GH}', 2) END AS repo,
             regexp_replace(regexp_split_to_array(regexp_replace(url, '/+$', ''), '[/:]')[-1], '\\.git$', '') AS b FROM u)
SELECT id, owner, repo, coalesce(nullif(b, ''), 'repo') AS basename,
       CASE WHEN owner IS NOT NULL THEN {_sanitize_sql("'fork_' || owner || '_' || repo")} END AS remote_name
FROM p""",
)
def q_repo_catalog(repo: Repo) -> DataFrame:
    u = TD.repo_urls(repo)
    owner = TF.github_owner(F.col("url"))
    name = TF.github_repo(F.col("url"))
    return u.select(
        "id", owner.alias("owner"), name.alias("repo"), TF.repo_basename(F.col("url")).alias("basename"),
        F.when(owner.isNotNull(), TF.sanitize_remote_name(F.concat(F.lit("fork_"), owner, F.lit("_"), name))).alias("remote_name"),
    )


# --- B14, B15, E9 -------------------------------------------------------------------

_MS = "(CAST(trunc(value * 1000) AS BIGINT) * (event_id % 200))"


def _unit_sql(n: str, word: str) -> str:
    return f"({n}) || ' {word}' || CASE WHEN ({n}) <> 1 THEN 's' ELSE '' END"


def _join_sql(parts: list[str]) -> str:
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return (
        f"(CASE WHEN len({arr}) = 1 THEN ', and ' || {arr}[1] WHEN len({arr}) = 2 THEN {arr}[1] || ' and ' || {arr}[2] "
        f"ELSE array_to_string({arr}[1:len({arr}) - 1], ', ') || ', and ' || {arr}[len({arr})] END)"
    )


def humanize_sql(ms: str) -> str:
    s, rms = f"({ms}) // 1000", f"({ms}) % 1000"
    m, rs = f"({ms}) // 60000", f"(({ms}) // 1000) % 60"
    h, rm = f"({ms}) // 3600000", f"(({ms}) // 60000) % 60"
    under_hour = _join_sql([
        f"'Took ' || {_unit_sql(m, 'minute')}",
        f"CASE WHEN {rs} > 0 THEN {_unit_sql(rs, 'second')} END",
        f"CASE WHEN {rms} > 0 THEN {_unit_sql(rms, 'millisecond')} END",
    ])
    longer = _join_sql([
        f"'Took ' || {_unit_sql(h, 'hour')}",
        f"CASE WHEN {rm} > 0 THEN {_unit_sql(rm, 'minute')} END",
        f"CASE WHEN {rs} > 0 THEN {_unit_sql(rs, 'second')} END",
        f"CASE WHEN {rms} > 0 THEN {_unit_sql(rms, 'millisecond')} END",
    ])
    return (
        f"(CASE WHEN ({ms}) <= 0 THEN 'wasn''t applied or run' WHEN ({ms}) < 1000 THEN 'Took ' || ({ms}) || ' milliseconds' "
        f"WHEN {s} < 60 THEN CASE WHEN {rms} = 0 THEN 'Took ' || {s} || ' seconds' ELSE 'Took ' || {s} || ' seconds and ' || {rms} || ' milliseconds' END "
        f"WHEN {m} < 60 THEN {under_hour} ELSE {longer} END)"
    )


@register("humanize_ms", "B14", f"SELECT event_id, {_MS} AS ms, {humanize_sql(_MS)} AS text FROM events")
def q_humanize(repo: Repo) -> DataFrame:
    e = repo.table("events")
    ms = (F.col("value") * 1000).cast("long") * (F.col("event_id") % 200)
    return e.select("event_id", ms.alias("ms"), TF.humanize_ms(ms).alias("text"))


@register(
    "format_ts_ms",
    "B15",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_text, CAST(round_even(value * 1000.0, 0) AS BIGINT) || ' ms' AS ms_text FROM events",
)
def q_format_ts(repo: Repo) -> DataFrame:
    e = repo.table("events")
    return e.select("event_id", TF.format_ts_ms(F.col("ts")).alias("ts_text"), TF.format_ms(F.col("value")).alias("ms_text"))


@register(
    "step_metrics",
    "E9",
    f"""WITH ev AS (SELECT user_id AS run_id, event_type AS step, ts AS start_ts, make_timestamp(epoch_us(ts) + {_MS} * 1000) AS end_ts FROM events),
a AS (SELECT run_id, coalesce(step, 'total') AS step, grouping(step) = 1 AS is_total, min(start_ts) AS s, max(end_ts) AS e,
             CAST(sum((epoch_us(end_ts) - epoch_us(start_ts)) // 1000) AS BIGINT) AS ms
      FROM ev GROUP BY ROLLUP (run_id, step) HAVING run_id IS NOT NULL)
SELECT run_id, step, is_total, strftime(s, '%Y-%m-%d %H:%M:%S.%g') AS start, strftime(e, '%Y-%m-%d %H:%M:%S.%g') AS "end", ms,
       {humanize_sql('ms')} AS difference_time FROM a""",
)
def q_step_metrics(repo: Repo) -> DataFrame:
    return step_metrics(TD.step_events(repo))
