"""Queries for the similarity joins (D7, C4), the full cascade (D8), its
ranking (F1) and its outputs (A1, A2, A4, A5, A6, E8)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.functions import content as C
from blobtrail.operators import cascade as CS
from blobtrail.operators.fingerprint_tables import with_fingerprint, with_stream
from blobtrail.operators.pairs import minhash_pairs, set_pairs, simhash_pairs, simhash_ranks
from blobtrail.operators.ranking import ordered_rank
from blobtrail.operators import forks as FK
from blobtrail.operators import history as H
from blobtrail.operators import query_files as QF
from blobtrail.operators.metrics import fork_counters
from blobtrail.plans import q_catalog
from blobtrail.plans import report as R
from blobtrail.plans import sqlfrag as S
from blobtrail.plans.oracle_views import blob_sql, with_views
from blobtrail.plans.q_history import HINT_PATHS_SQL, PATHS_SQL, PR_SQL, PRIO_SQL, attrs_sql, branch_info, commit_attrs, groups, parts, reach
from blobtrail.plans.registry import register
from blobtrail.session import ensure_checkpoint_dir
from blobtrail.sources.testdata import FORK_BLOCK, Repo, fork_targets

K, N, W, P = 5, 5, 4, 128
THRESHOLDS = {"jaccard": 0.8, "charjaccard": 0.8, "winnow": 0.8, "minhash": 0.8, "simhash": 0.9}
CASCADE_T = 0.92


# --- D7: similarity joins over distinct document contents -----------------------


def _contents(repo: Repo) -> DataFrame:
    """Distinct texts, each represented by its smallest doc_id: copies of a
    text cost one row, never a quadratic number of pairs."""
    d = repo.table("documents")
    return d.groupBy("text").agg(F.min("doc_id").alias("key"))


def _fingerprints(repo: Repo, mode: str) -> DataFrame:
    return with_fingerprint(_contents(repo), "text", mode, k=K, n=N, window=W, num_perm=P).select("key", "fp")


def _sim_join(repo: Repo, mode: str) -> DataFrame:
    t = THRESHOLDS[mode]
    f = with_stream(_contents(repo), "text").select("key", "fp") if mode == "charjaccard" else _fingerprints(repo, mode)
    if mode == "minhash":
        pairs = minhash_pairs(f, None, t, P, sig="fp")
    elif mode == "simhash":
        pairs = simhash_pairs(f, None, t, fp="fp", by="tiles")
    elif mode == "charjaccard":
        pairs = set_pairs(f, None, t, items="fp", by="sketch", grams=N)
    else:
        pairs = set_pairs(f, None, t, items="fp")
    return pairs.select(F.col("l_key").alias("doc_a"), F.col("r_key").alias("doc_b"), F.round("score", 6).alias("score"))


_CONTENTS_SQL = "c AS (SELECT min(doc_id) AS rep, text FROM documents GROUP BY text)"


def _set_join_sql(set_expr: str, t: float) -> str:
    return f"""WITH {_CONTENTS_SQL},
s AS (SELECT rep, {set_expr} AS s FROM {S.features('rep', 'text', 'c', K)}),
e AS (SELECT rep, greatest(len(s), 1) AS n, unnest(CASE WHEN len(s) = 0 THEN ['<empty>'] ELSE s END) AS item FROM s),
pr AS (SELECT a.rep AS doc_a, b.rep AS doc_b, count(*) AS inter, any_value(a.n) AS na, any_value(b.n) AS nb
       FROM e a JOIN e b ON a.item = b.item AND a.rep < b.rep GROUP BY 1, 2)
SELECT doc_a, doc_b, round(inter / (na + nb - inter), 6) AS score FROM pr WHERE inter / (na + nb - inter) >= {t}"""


_TOK = S.tokens("text")
_SET_EXPR = {m: f(K, N, W) for m, f in S.SET_EXPR.items()}


for _mode in ("jaccard", "charjaccard", "winnow"):
    register(f"similarity_join_{_mode}", "D7", _set_join_sql(_SET_EXPR[_mode], THRESHOLDS[_mode]))(
        (lambda m: lambda repo: _sim_join(repo, m))(_mode)
    )


def _sig_items(key: str, sigs: str) -> str:
    """Positions of signatures as rows (key, i, v)."""
    return f"(SELECT {key}, unnest(sig) AS v, unnest(range({P})) AS i FROM {sigs})"


register(
    "similarity_join_minhash",
    "D7",
    f"WITH {_CONTENTS_SQL}, src AS (SELECT rep, list_distinct({S.shingles('t', K)}) AS s FROM (SELECT rep, {_TOK} AS t FROM c)),"
    + S.minhash_cte("src", "rep", "s", P).lstrip()
    + f""",
e AS {_sig_items('rep', 'mh')}
SELECT a.rep AS doc_a, b.rep AS doc_b, round(count(*) / {P}.0, 6) AS score FROM e a JOIN e b ON a.i = b.i AND a.v = b.v AND a.rep < b.rep
GROUP BY 1, 2 HAVING count(*) / {P}.0 >= {THRESHOLDS['minhash']}""",
)(lambda repo: _sim_join(repo, "minhash"))


register(
    "similarity_join_simhash",
    "D7",
    f"WITH {_CONTENTS_SQL}, src AS (SELECT rep, {_TOK} AS tok FROM c),"
    + S.simhash_cte("src", "rep", "tok").lstrip()
    + f"""
SELECT a.rep AS doc_a, b.rep AS doc_b, round(1 - bit_count(xor(a.u, b.u)) / 64.0, 6) AS score
FROM sh a JOIN sh b ON a.rep < b.rep WHERE 1 - bit_count(xor(a.u, b.u)) / 64.0 >= {THRESHOLDS['simhash']}""",
)(lambda repo: _sim_join(repo, "simhash"))


_SIMHASH_PAIRS_SQL = (
    f"WITH {_CONTENTS_SQL}, src AS (SELECT rep, {_TOK} AS tok FROM c),"
    + S.simhash_cte("src", "rep", "tok").lstrip()
    + f""",
p AS (SELECT a.rep AS doc_a, b.rep AS doc_b, round(1 - bit_count(xor(a.u, b.u)) / 64.0, 6) AS score
      FROM sh a JOIN sh b ON a.rep < b.rep WHERE 1 - bit_count(xor(a.u, b.u)) / 64.0 >= {THRESHOLDS['simhash']})"""
)
NARROWER = 61 / 64  # a score that pairs reach exactly


@register("threshold_filter_pairs", "C4", _SIMHASH_PAIRS_SQL + f"\nSELECT doc_a, doc_b, score FROM p WHERE score >= {NARROWER}")
def q_threshold_pairs(repo: Repo) -> DataFrame:
    """Similar pairs filtered at a score that many of them have exactly; the
    limit is inclusive. The pairs pass the filter as they are found."""
    return _sim_join(repo, "simhash").where(F.col("score") >= NARROWER)


@register(
    "rank_similar",
    "F1",
    _SIMHASH_PAIRS_SQL
    + """,
b AS (SELECT doc_a AS doc, doc_b AS other, score FROM p UNION ALL SELECT doc_b, doc_a, score FROM p)
SELECT doc, other, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, other) AS rank FROM b""",
)
def q_rank_similar(repo: Repo) -> DataFrame:
    """The similar contents of every content, best first, ties in the order of
    the other's id; few scores, so most ranks are ties."""
    ranked = simhash_ranks(_fingerprints(repo, "simhash"), THRESHOLDS["simhash"])
    return ranked.select("doc", "other", F.round("score", 6).alias("score"), "rank")


# --- D8 cascade -----------------------------------------------------------------


def cascade(repo: Repo, mode: str = "jaccard", contains_only: bool = True) -> dict:
    def build() -> dict:
        return CS.match_cascade(
            repo.query_files(), repo.file_versions(), repo.changes(), repo.path_objects(),
            commit_attrs(repo).select("commit_id", "ts", "is_priority"),
            CS.MatchParams(similarity_mode=mode, threshold=CASCADE_T, contains_only=contains_only),
        )

    return repo.memo(f"cascade {mode} {contains_only}", build)


def _all_groups(repo: Repo) -> tuple[DataFrame, dict]:
    """Content groups of all queries and their fallback tables."""
    return groups(repo), parts(repo)


def _set_scores_sql(mode: str) -> str:
    expr = S.SET_EXPR[mode](K, N, W)
    return f"""
qset AS (SELECT name, bn, {expr} AS s FROM {S.features('name, bn', 'lf', 'qs', K)}),
vset AS (SELECT name, nblob, {expr} AS s FROM {S.features('name, nblob', 'content_lf', 'vs', K)}),
qi AS (SELECT name, bn, greatest(len(s), 1) AS n, unnest(CASE WHEN len(s) = 0 THEN ['<empty>'] ELSE s END) AS item FROM qset),
vi AS (SELECT name, nblob, greatest(len(s), 1) AS n, unnest(CASE WHEN len(s) = 0 THEN ['<empty>'] ELSE s END) AS item FROM vset),
sx AS (SELECT qi.name, qi.bn, vi.nblob, count(*) AS inter, any_value(qi.n) AS nq, any_value(vi.n) AS nv
       FROM qi JOIN vi ON vi.name = qi.name AND vi.item = qi.item GROUP BY 1, 2, 3),
sc AS (SELECT name, bn, nblob, inter / (nq + nv - inter) AS score FROM sx)"""


def _minhash_scores_sql() -> str:
    sets = lambda src, key, text: f"(SELECT name, {key}, name || '/' || {key} AS k, list_distinct({S.shingles('t', K)}) AS s FROM (SELECT name, {key}, {S.tokens(text)} AS t FROM {src}))"
    return f"""
qk AS {sets('qs', 'bn', 'lf')}, vk AS {sets('vs', 'nblob', 'content_lf')},
{S.minhash_cte('qk', 'k', 's', P, 'mq').lstrip()},
{S.minhash_cte('vk', 'k', 's', P, 'mv').lstrip()},
qe AS (SELECT q.name, q.bn, e.v, e.i FROM qk q JOIN {_sig_items('k', 'mq')} e ON e.k = q.k),
ve AS (SELECT q.name, q.nblob, e.v, e.i FROM vk q JOIN {_sig_items('k', 'mv')} e ON e.k = q.k),
sc AS (SELECT qe.name, qe.bn, ve.nblob, count(*) / {P}.0 AS score FROM qe JOIN ve ON ve.name = qe.name AND ve.i = qe.i AND ve.v = qe.v GROUP BY 1, 2, 3)"""


def _simhash_scores_sql() -> str:
    toks = lambda src, key, text: f"(SELECT name, {key}, name || '/' || {key} AS k, {S.tokens(text)} AS tok FROM {src})"
    return f"""
qk AS {toks('qs', 'bn', 'lf')}, vk AS {toks('vs', 'nblob', 'content_lf')},
{S.simhash_cte('qk', 'k', 'tok', 'sq').lstrip()},
{S.simhash_cte('vk', 'k', 'tok', 'sv').lstrip()},
sc AS (SELECT a.name, a.bn, b.nblob, 1 - bit_count(xor(x.u, y.u)) / 64.0 AS score
       FROM qk a JOIN vk b ON b.name = a.name JOIN sq x ON x.k = a.k JOIN sv y ON y.k = b.k)"""


def _scores_sql(mode: str) -> str:
    return {"minhash": _minhash_scores_sql, "simhash": _simhash_scores_sql}.get(mode, lambda: _set_scores_sql(mode))()


def cascade_sql(mode: str = "jaccard", contains_only: bool = True, crlf: bool = False, hints: bool = False) -> str:
    """The whole cascade per query in DuckDB: exact tier, hash tiers, fuzzy
    tier, own commit excluded, preferred commit by the selection rules; with
    ``crlf`` the CRLF form's id counts too, with ``hints`` the queries are
    those of ``hint_files``."""
    t = CASCADE_T
    kinds = "('add')" if contains_only else "('add', 'remove')"
    raw = blob_sql("replace(lf, chr(10), chr(13) || chr(10))") if crlf else blob_sql("lf")
    files = "hint_files" if hints else "query_files"
    name = "name" if hints else "regexp_extract(path, '[^/]*$')"
    return (
        attrs_sql()
        + ","
        + with_views("file_versions", "changes", "path_objects", files)[len("WITH "):]
        + ","
        + (HINT_PATHS_SQL if hints else PATHS_SQL)
        + f""",
q AS (SELECT query_id, self_commit, {name} AS name, lf, {blob_sql('lf')} AS bn, {raw} AS br
      FROM (SELECT *, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS lf FROM {files})),
ex AS (SELECT q.query_id, c.commit_id, min(CASE WHEN c.blob_id = q.bn THEN 0 ELSE 1000000000000 END + c.log_ord) AS o
       FROM q JOIN changes c ON c.blob_id = q.bn OR c.blob_id = q.br
       WHERE c.kind IN {kinds} AND c.commit_id <> q.self_commit GROUP BY 1, 2),
firsth AS (SELECT name, commit_id, content_lf, t_path_ord, t_log_ord, {blob_sql('content_lf')} AS nblob FROM first),
d4q AS (SELECT q.query_id, t.commit_id, t.path_ord, t.log_ord FROM q JOIN paths p ON p.name = q.name
        JOIN file_versions fv ON fv.path = p.path AND fv.blob_id IN (q.bn, q.br) AND length(fv.blob_id) = 40
        JOIN touched t ON t.name = q.name AND t.commit_id = fv.commit_id WHERE t.commit_id <> q.self_commit),
d6q AS (SELECT q.query_id, f.commit_id, f.t_path_ord AS path_ord, f.t_log_ord AS log_ord
        FROM q JOIN firsth f ON f.name = q.name AND f.nblob IN (q.bn, q.br) WHERE f.commit_id <> q.self_commit),
hq AS (SELECT DISTINCT * FROM (SELECT * FROM d4q UNION ALL SELECT * FROM d6q)),
qs AS (SELECT name, bn, any_value(lf) AS lf, any_value(br) AS br FROM q GROUP BY 1, 2),
vs AS (SELECT name, nblob, any_value(content_lf) AS content_lf FROM firsth GROUP BY 1, 2),
{_scores_sql(mode).lstrip()},
fz AS (SELECT sc.name, sc.bn, nblob, score FROM sc JOIN qs ON qs.name = sc.name AND qs.bn = sc.bn WHERE score >= {t} AND nblob <> sc.bn AND nblob <> qs.br),
fq AS (SELECT q.query_id, f.commit_id, fz.score, f.t_path_ord AS path_ord, f.t_log_ord AS log_ord
       FROM q JOIN fz ON fz.name = q.name AND fz.bn = q.bn JOIN firsth f ON f.name = fz.name AND f.nblob = fz.nblob
       WHERE f.commit_id <> q.self_commit),
ne AS (SELECT query_id, count(*) AS n FROM ex GROUP BY 1),
nh AS (SELECT query_id, count(*) AS n FROM hq GROUP BY 1),
nf AS (SELECT query_id, count(*) AS n FROM fq GROUP BY 1),
tier AS (SELECT q.query_id, q.bn, q.name,
                CASE WHEN coalesce(ne.n, 0) > 0 THEN 1 WHEN coalesce(nh.n, 0) > 0 THEN 2 WHEN coalesce(nf.n, 0) > 0 THEN 3 END AS tier,
                CASE WHEN coalesce(ne.n, 0) > 0 THEN ne.n WHEN coalesce(nh.n, 0) > 0 THEN nh.n ELSE coalesce(nf.n, 0) END AS cnt
         FROM q LEFT JOIN ne ON ne.query_id = q.query_id LEFT JOIN nh ON nh.query_id = q.query_id LEFT JOIN nf ON nf.query_id = q.query_id),
cands AS (SELECT query_id, commit_id, 1 AS tier, 0.0::DOUBLE AS ns, 0 AS r1, o AS r2, 0 AS r3 FROM ex
          UNION ALL SELECT query_id, commit_id, 2, 0.0::DOUBLE, 1, path_ord, log_ord FROM hq
          UNION ALL SELECT query_id, commit_id, 3, -score, 1, path_ord, log_ord FROM fq),
pick AS (SELECT c.query_id, c.commit_id, c.ns, row_number() OVER (PARTITION BY c.query_id ORDER BY
           CASE WHEN a.prio THEN 0 ELSE 1 END, CASE WHEN a.prio THEN c.ns END, CASE WHEN a.prio THEN c.r1 END,
           CASE WHEN a.prio THEN c.r2 END, CASE WHEN a.prio THEN c.r3 END, -a.ts, c.ns, c.r1, c.r2, c.r3) AS rn
         FROM cands c JOIN tier t ON t.query_id = c.query_id AND t.tier = c.tier JOIN attrs a ON a.commit_id = c.commit_id),
summary AS (SELECT t.query_id, CASE WHEN t.tier = 1 THEN 'exact_blob' WHEN t.tier IS NOT NULL THEN 'normalized_path' ELSE 'no_match' END AS mode,
                   p.commit_id AS preferred, t.cnt AS candidates_count, t.bn AS local_blob_norm, t.tier, t.name
            FROM tier t LEFT JOIN pick p ON p.query_id = t.query_id AND p.rn = 1)"""
    )


for _mode in ("jaccard", "charjaccard", "winnow", "minhash", "simhash"):
    register(
        f"match_cascade_{_mode}",
        "D8",
        (lambda m: lambda: cascade_sql(m) + "\nSELECT query_id, mode, preferred, candidates_count FROM summary")(_mode),
    )((lambda m: lambda repo: cascade(repo, m)["summary"].select("query_id", "mode", "preferred", "candidates_count"))(_mode))


@register(
    "match_cascade_all_changes",
    "D8",
    lambda: cascade_sql("jaccard", contains_only=False) + "\nSELECT query_id, mode, preferred, candidates_count FROM summary",
)
def q_cascade_all_changes(repo: Repo) -> DataFrame:
    """The cascade with its default: commits that remove a blob are exact
    hits too."""
    return cascade(repo, contains_only=False)["summary"].select("query_id", "mode", "preferred", "candidates_count")


@register(
    "match_cascade_crlf",
    "D8",
    lambda: cascade_sql("jaccard", crlf=True) + "\nSELECT query_id, mode, preferred, candidates_count FROM summary",
)
def q_cascade_crlf(repo: Repo) -> DataFrame:
    """The cascade with the id of the CRLF form as a second id of each file:
    versions stored with CRLF line ends are exact hits."""
    return _run_cascade(repo, repo.query_files(), CS.MatchParams(threshold=CASCADE_T, contains_only=True, crlf_variant=True))


@register(
    "match_cascade_hint",
    "D8",
    lambda: cascade_sql("jaccard", hints=True)
    + """
SELECT s.query_id, mode, preferred, candidates_count, CASE WHEN mode = 'no_match' THEN
  CASE WHEN EXISTS (SELECT 1 FROM paths p WHERE p.name = s.name) THEN 'no candidates' ELSE 'no candidate paths' END END AS reason FROM summary s""",
)
def q_cascade_hint(repo: Repo) -> DataFrame:
    """The cascade for files that come with a hint path, some of them without
    a name of their own."""
    return _run_cascade(repo, repo.hint_files(), CS.MatchParams(threshold=CASCADE_T, contains_only=True), "reason")


def _run_cascade(repo: Repo, files: DataFrame, params: CS.MatchParams, *more: str) -> DataFrame:
    attrs = commit_attrs(repo).select("commit_id", "ts", "is_priority")
    out = CS.match_cascade(files, repo.file_versions(), repo.changes(), repo.path_objects(), attrs, params)
    return out["summary"].select("query_id", "mode", "preferred", "candidates_count", *more)


@register(
    "threshold_filter",
    "C4",
    lambda: cascade_sql("jaccard") + "\nSELECT name, bn AS blob_norm, nblob, round(score, 6) AS score FROM fz",
)
def q_threshold(repo: Repo) -> DataFrame:
    """Fuzzy scores of the cascade kept at score >= threshold (inclusive),
    per (name, query content, version content)."""
    g, p = _all_groups(repo)
    sc = CS.fuzzy_scores(g, p, repo.file_versions(), CS.MatchParams(similarity_mode="jaccard", threshold=CASCADE_T))
    return sc.select("name", "blob_norm", "nblob", F.round("score", 6).alias("score"))


@register(
    "rank_candidates",
    "F1",
    lambda: cascade_sql("jaccard")
    + """,
fr AS (SELECT fz.name, fz.bn, f.commit_id, fz.score, f.t_path_ord, f.t_log_ord FROM fz JOIN firsth f ON f.name = fz.name AND f.nblob = fz.nblob)
SELECT name, bn AS blob_norm, commit_id, round(score, 6) AS score,
       row_number() OVER (PARTITION BY name, bn ORDER BY score DESC, t_path_ord, t_log_ord) AS rank
FROM fr""",
)
def q_rank(repo: Repo) -> DataFrame:
    """Fuzzy candidates of every content group ranked by score (descending),
    ties in touched order; the rank is computed without gathering a group
    into one task."""
    g, p = _all_groups(repo)
    fz = CS.fuzzy_tier(g, p, repo.file_versions(), CS.MatchParams(similarity_mode="jaccard", threshold=CASCADE_T))
    ranked = ordered_rank(fz, ["name", "blob_norm"], [F.col("o"), F.col("commit_id")])
    return ranked.select("name", "blob_norm", "commit_id", F.round("score", 6).alias("score"), "rank")


# --- A1, A2 ---------------------------------------------------------------------


@register(
    "read_query_files",
    "A1",
    f"""SELECT query_id, octet_length(encode(lf)) AS n_bytes, {blob_sql('lf')} AS blob_norm FROM (
  SELECT doc_id AS query_id, regexp_replace(CASE WHEN doc_id % 2 = 1 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END,
                                            '\\r\\n?', chr(10), 'g') AS lf FROM documents)""",
)
def q_read_query_files(repo: Repo) -> DataFrame:
    """Query files as they arrive (odd ones with CRLF line ends), read and
    LF-normalised."""
    d = repo.table("documents")
    raw = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    qf = d.select(F.col("doc_id").alias("query_id"), F.concat("lang", F.lit(".txt")).alias("path"), F.encode(raw, "UTF-8").alias("content"))
    q = CS.prepare_queries(qf, crlf=False)
    return q.select("query_id", F.octet_length("content_lf").alias("n_bytes"), "blob_norm")


@register(
    "read_landed_files",
    "A1",
    f"""SELECT query_id, octet_length(encode(lf)) AS length, {blob_sql('lf')} AS blob_norm FROM (
  SELECT doc_id AS query_id, text || chr(10) AS lf FROM documents)""",
)
def q_read_landed(repo: Repo) -> DataFrame:
    """Every document landed as a file of its own (as text files they end in a
    line feed) and read back against the manifest of these files."""
    folder = f"{ensure_checkpoint_dir(repo.spark).rstrip('/')}/landed-{uuid.uuid4().hex}"
    texts = repo.table("documents").select(F.col("doc_id").alias("id"), "text")
    QF.land_texts(texts, folder)
    manifest = texts.select(F.col("id").alias("query_id"), QF.landed_path(F.col("id")).alias("path")).distinct()
    return QF.read_query_files(repo.spark, manifest, folder).select("query_id", "length", "blob_norm")


@register(
    "read_file_versions",
    "A2",
    with_views("file_versions")
    + """,
req AS (SELECT doc_id AS commit_id, source || '/en.txt' AS path FROM documents)
SELECT r.commit_id, r.path, fv.blob_id, octet_length(encode(fv.content)) AS n_bytes
FROM req r LEFT JOIN file_versions fv ON fv.commit_id = r.commit_id AND fv.path = r.path""",
)
def q_read_versions(repo: Repo) -> DataFrame:
    """Content of '<source>/en.txt' at every commit; null where absent."""
    req = repo.table("documents").select(F.col("doc_id").alias("commit_id"), F.concat("source", F.lit("/en.txt")).alias("path"))
    fv = repo.file_versions()
    j = req.join(fv, ["commit_id", "path"], "left")
    return j.select("commit_id", "path", "blob_id", F.octet_length(C.as_bytes(F.col("content"))).alias("n_bytes"))


# --- A4, A5, A6, E8 -------------------------------------------------------------


def query_forks(repo: Repo) -> DataFrame:
    """Fork counters per query: the queries look at all targets in turn; all
    forks that were selected were fetched."""
    combined = q_catalog.combined_forks(repo)
    counts = fork_counters(combined, FK.fork_window(combined, q_catalog.OFFSET, q_catalog.LIMIT))
    q = repo.table("documents").select(
        F.col("doc_id").alias("query_id"), F.concat(F.lit("org"), (F.col("doc_id") % fork_targets(repo)).cast("string"), F.lit("/proj")).alias("target")
    )
    return q.join(counts, "target").select("query_id", F.col("forks_selected").alias("forks_fetched"), "forks_discovered", "forks_selected")


def _report_sql(select: str) -> str:
    """``select`` over the summary joined to the fork counters (s)."""
    forks = q_catalog.FORKS_SQL.strip()[len("WITH "):]
    return (
        cascade_sql("jaccard")
        + ","
        + forks
        + f""",
fc AS (SELECT c.target, count(*) AS forks_discovered, count(*) FILTER (WHERE cpos > {q_catalog.OFFSET} AND cpos <= {q_catalog.OFFSET + q_catalog.LIMIT}) AS forks_selected
       FROM combined c GROUP BY 1),
brs AS (SELECT commit_id, string_agg(branch, chr(9) || chr(10) ORDER BY branch) AS branches FROM reach GROUP BY 1),
cls AS (SELECT commit_id, branch, row_number() OVER (PARTITION BY commit_id ORDER BY
          CASE WHEN regexp_matches(branch, '{PRIO_SQL}') THEN 0 WHEN regexp_matches(branch, '{PR_SQL}') THEN 1 ELSE 2 END, branch) AS rn FROM reach),
s AS (SELECT s.*, c.branch, b.branches, coalesce(fc.forks_selected, 0) AS forks_fetched, coalesce(fc.forks_discovered, 0) AS forks_discovered,
             coalesce(fc.forks_selected, 0) AS forks_selected
      FROM summary s LEFT JOIN cls c ON c.commit_id = s.preferred AND c.rn = 1 LEFT JOIN brs b ON b.commit_id = s.preferred
      LEFT JOIN fc ON fc.target = 'org' || (s.query_id % (SELECT coalesce(max(page_id) // {FORK_BLOCK} + 2, 1) FROM pages)) || '/proj')
"""
        + select
    )


@register(
    "match_report",
    "A4",
    lambda: _report_sql(
        """SELECT query_id, mode, preferred, local_blob_norm, CAST(NULL AS VARCHAR) AS local_blob_raw,
       forks_fetched, forks_discovered, forks_selected, candidates_count,
       'mode=' || mode || chr(10) || 'preferred=' || coalesce(CAST(preferred AS VARCHAR), '') || chr(10) ||
       'local_blob_norm=' || local_blob_norm || chr(10) || 'forks_fetched=' || forks_fetched || chr(10) || 'forks_discovered=' || forks_discovered || chr(10) ||
       'forks_selected=' || forks_selected || chr(10) || 'candidates_count=' || candidates_count || chr(10) || 'candidates:' AS report_head
FROM s"""
    ),
)
def q_report(repo: Repo) -> DataFrame:
    return R.match_report(cascade(repo)["summary"], query_forks(repo))


_GROUP_CANDIDATES_SQL = """,
gx AS (SELECT CAST(NULL AS VARCHAR) AS name, n.bn, 1 AS tier, c.commit_id, 0.0::DOUBLE AS ns, 0 AS r1, min(c.log_ord) AS r2, 0 AS r3
       FROM (SELECT DISTINCT bn FROM tier WHERE tier = 1) n JOIN changes c ON c.blob_id = n.bn WHERE c.kind = 'add' GROUP BY n.bn, c.commit_id),
gh AS (SELECT DISTINCT n.name, n.bn, 2 AS tier, t.commit_id, 0.0::DOUBLE AS ns, 1 AS r1, t.path_ord AS r2, t.log_ord AS r3
       FROM (SELECT DISTINCT name, bn FROM tier WHERE tier = 2) n JOIN touched t ON t.name = n.name
       LEFT JOIN firsth f ON f.name = n.name AND f.commit_id = t.commit_id AND f.nblob = n.bn
       LEFT JOIN (SELECT p.name, fv.commit_id, fv.blob_id FROM paths p JOIN file_versions fv ON fv.path = p.path) v
         ON v.name = n.name AND v.commit_id = t.commit_id AND v.blob_id = n.bn
       WHERE f.commit_id IS NOT NULL OR v.commit_id IS NOT NULL),
gf AS (SELECT n.name, n.bn, 3 AS tier, f.commit_id, -fz.score AS ns, 1 AS r1, f.t_path_ord AS r2, f.t_log_ord AS r3
       FROM (SELECT DISTINCT name, bn FROM tier WHERE tier = 3) n JOIN fz ON fz.name = n.name AND fz.bn = n.bn
       JOIN firsth f ON f.name = fz.name AND f.nblob = fz.nblob),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name, bn, tier ORDER BY ns, r1, r2, r3, commit_id) AS rank
           FROM (SELECT * FROM gx UNION ALL SELECT * FROM gh UNION ALL SELECT * FROM gf)),
brs AS (SELECT commit_id, string_agg(branch, chr(9) || chr(10) ORDER BY branch) AS branches FROM reach GROUP BY 1)
"""


@register(
    "match_candidates",
    "A4",
    lambda: cascade_sql("jaccard")
    + _GROUP_CANDIDATES_SQL
    + """SELECT name, bn AS blob_norm, tier, rank, r.commit_id,
  '  - commit=' || r.commit_id || ' ts=' || coalesce(a.ts, 0) || ' branches=' || coalesce(b.branches, '') AS line
FROM ranked r LEFT JOIN attrs a ON a.commit_id = r.commit_id LEFT JOIN brs b ON b.commit_id = r.commit_id""",
)
def q_candidates(repo: Repo) -> DataFrame:
    """Candidate lines of the report, per content group and rank."""
    c = cascade(repo)["candidates"]
    return R.candidate_lines(c, commit_attrs(repo).select("commit_id", "ts"), H.labelled_branch_lists(*reach(repo), c))


@register(
    "match_candidates_fast",
    "A5",
    lambda: cascade_sql("jaccard")
    + _GROUP_CANDIDATES_SQL
    + "SELECT name, bn AS blob_norm, tier, rank, commit_id, '  - commit=' || commit_id AS line FROM ranked",
)
def q_candidates_fast(repo: Repo) -> DataFrame:
    """The fast shape: the ranked commits (CANDIDATE_COMMITS) alone, without
    looking up times and branches."""
    return R.candidate_lines(cascade(repo)["candidates"], None, None)


@register(
    "match_env",
    "A5",
    lambda: _report_sql(
        """SELECT query_id, 'PREFERRED_COMMIT' AS key, coalesce(CAST(preferred AS VARCHAR), '') AS value FROM s
UNION ALL SELECT query_id, 'MATCH_MODE', mode FROM s
UNION ALL SELECT query_id, 'FORKS_FETCHED', CAST(forks_fetched AS VARCHAR) FROM s
UNION ALL SELECT query_id, 'FORKS_DISCOVERED', CAST(forks_discovered AS VARCHAR) FROM s
UNION ALL SELECT query_id, 'FORKS_SELECTED', CAST(forks_selected AS VARCHAR) FROM s
UNION ALL SELECT query_id, 'PREFERRED_BRANCH', branch FROM s WHERE branch IS NOT NULL AND branch <> ''
UNION ALL SELECT query_id, 'PREFERRED_BRANCHES', '"' || branches || '"' FROM s WHERE branch IS NOT NULL AND branch <> ''"""
    ),
)
def q_env(repo: Repo) -> DataFrame:
    summary = cascade(repo)["summary"]
    preferred = summary.select(F.col("preferred").alias("commit_id"))
    return R.match_env(summary, branch_info(repo), H.labelled_branch_lists(*reach(repo), preferred), query_forks(repo))


@register(
    "match_summary",
    "A6",
    lambda: cascade_sql("jaccard")
    + "\nSELECT query_id, preferred, candidates_count, 'Recommended commit: ' || coalesce(CAST(preferred AS VARCHAR), '') AS line FROM summary",
)
def q_summary(repo: Repo) -> DataFrame:
    return R.match_summary(cascade(repo)["summary"])


@register(
    "match_no_match",
    "D8",
    lambda: cascade_sql("jaccard")
    + """
SELECT query_id, CASE WHEN EXISTS (SELECT 1 FROM paths p WHERE p.name = summary.name) THEN 'no candidates' ELSE 'no candidate paths' END AS reason
FROM summary WHERE mode = 'no_match'""",
)
def q_no_match(repo: Repo) -> DataFrame:
    """Queries that no tier settles, by reason."""
    return cascade(repo)["summary"].where("mode = 'no_match'").select("query_id", "reason")


@register(
    "match_counters",
    "E8",
    lambda: cascade_sql("jaccard")
    + """
SELECT mode, count(*) AS queries, CAST(sum(candidates_count) AS BIGINT) AS candidates, count(preferred) AS with_preferred FROM summary GROUP BY mode""",
)
def q_counters(repo: Repo) -> DataFrame:
    from blobtrail.operators.metrics import match_counters

    return match_counters(cascade(repo, "jaccard")["summary"])
