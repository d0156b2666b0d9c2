"""The same repository views as ``blobtrail.sources.testdata``, written as
plain SQL CTEs for the DuckDB oracle (tables are pre-registered views)."""

from __future__ import annotations

from blobtrail.sources.testdata import (
    BAD_TS_MOD,
    BAD_TS_REM,
    BRANCH_BY_SOURCE,
    CHAIN_STEP,
    CRLF_MOD,
    CRLF_REM,
    FEATURE_PREFIX,
    MERGE_EVERY,
    RENAME_MOD,
    RENAME_REM,
    TS_BASE,
    TS_MOD,
    TS_STEP,
    TREE_AGE,
    TREE_COPY,
    TREE_DIRS,
    TREE_EDIT_AGE,
    TREE_MOVE,
)

LF = "chr(10)"
CR = "chr(13)"


def blob_sql(expr: str) -> str:
    b = f"encode({expr})"
    return f"sha1(('blob ' || octet_length({b})::VARCHAR)::BLOB || '\\x00'::BLOB || {b})"


def _branch_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{s}' THEN '{n}'" for s, n in BRANCH_BY_SOURCE.items())
    return f"CASE {whens} ELSE '{FEATURE_PREFIX}' || {col} END"


VIEWS = {
    "file_versions": f"""
file_versions AS (
  SELECT commit_id, path, content, log_ord, {blob_sql('content')} AS blob_id FROM (
    SELECT doc_id AS commit_id, source || '/' || lang || '.txt' AS path,
           CASE WHEN doc_id % {CRLF_MOD} = {CRLF_REM} THEN replace(text, {LF}, {CR} || {LF}) ELSE text END AS content,
           -doc_id AS log_ord
    FROM documents))""",
    "query_files": """
query_files AS (
  SELECT doc_id AS query_id, lang || '.txt' AS path, text AS content, doc_id AS self_commit FROM documents)""",
    "hint_files": """
hint_files AS (
  SELECT *, coalesce(base, '') || '|' || coalesce(hint, '') AS name FROM (
    SELECT *, coalesce(nullif(regexp_extract(path, '[^/]*$'), ''), nullif(regexp_extract(hint, '[^/]*$'), '')) AS base FROM (
      SELECT doc_id AS query_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang || '.txt' END AS path, text AS content, doc_id AS self_commit,
             CASE doc_id % 3 WHEN 0 THEN source || '/' || lang || '.txt' WHEN 1 THEN source || '/' || CASE WHEN lang = 'en' THEN 'de' ELSE 'en' END || '.txt' END AS hint
      FROM documents)))""",
    "commits": f"""
commits AS (
  SELECT doc_id AS commit_id, CASE WHEN doc_id % {BAD_TS_MOD} = {BAD_TS_REM} THEN 'notint'
         ELSE CAST({TS_BASE} + (doc_id * {TS_STEP}) % {TS_MOD} AS VARCHAR) END AS ts FROM documents)""",
    "commit_parents": f"""
commit_parents AS (
  SELECT doc_id AS commit_id, doc_id - {CHAIN_STEP} AS parent_id FROM documents WHERE doc_id >= {CHAIN_STEP}
  UNION ALL
  SELECT doc_id, doc_id - 1 FROM documents WHERE doc_id > 0 AND doc_id % {MERGE_EVERY} = 0)""",
    "changes": f"""
changes AS (
  SELECT c.commit_id, c.path, CASE WHEN c.commit_id % {RENAME_MOD} = {RENAME_REM} AND p.path <> c.path THEN p.path END AS old_path,
         c.blob_id, 'add' AS kind, c.log_ord
  FROM file_versions c LEFT JOIN file_versions p ON c.commit_id - {CHAIN_STEP} = p.commit_id
  UNION ALL
  SELECT c.commit_id, p.path, CAST(NULL AS VARCHAR), p.blob_id, 'remove', c.log_ord
  FROM file_versions c JOIN file_versions p ON c.commit_id - {CHAIN_STEP} = p.commit_id
  WHERE c.commit_id >= {CHAIN_STEP} AND p.blob_id <> c.blob_id)""",
    "trees": f"""
tree_files AS (
  SELECT d.doc_id, d.doc_id + {CHAIN_STEP} * a.age AS commit_id, (d.doc_id // {CHAIN_STEP}) % {TREE_AGE} AS slot,
         ((d.doc_id + {CHAIN_STEP} * a.age) // {CHAIN_STEP} // {TREE_MOVE}) % {TREE_DIRS} AS folder,
         CASE WHEN a.age >= {TREE_EDIT_AGE} THEN d.text || chr(10) || 'reviewed once more' || chr(10) ELSE d.text END AS content
  FROM documents d, range({TREE_AGE}) AS a(age) WHERE d.doc_id + {CHAIN_STEP} * a.age IN (SELECT doc_id FROM documents)),
trees AS (
  SELECT commit_id, path, content, {blob_sql('content')} AS blob_id FROM (
    SELECT commit_id, content, 'r' || (doc_id % {CHAIN_STEP}) || '/d' || folder || '/slot' || slot || '.txt' AS path FROM tree_files
    UNION ALL
    SELECT commit_id, content, 'r' || (doc_id % {CHAIN_STEP}) || '/d' || folder || '/copy' || ((slot + folder) % {TREE_AGE}) || '.txt'
    FROM tree_files WHERE doc_id % {TREE_COPY} = 0))""",
    "path_objects": """
path_objects AS (SELECT blob_id, path, log_ord AS ord FROM file_versions)""",
    "refs": f"""
refs AS (
  SELECT {_branch_case('source')} AS branch, max(doc_id) AS tip_commit FROM documents GROUP BY source)""",
}

_DEPS = {
    "changes": ["file_versions"],
    "path_objects": ["file_versions"],
}


def with_views(*names: str) -> str:
    """A WITH clause holding the named views (and what they depend on)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",".join(VIEWS[n] for n in order) + "\n"
