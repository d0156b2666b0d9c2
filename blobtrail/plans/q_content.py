"""Queries for the content, token and fingerprint operators (B1-B12,
E1-E7), over every document of the ``documents`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from blobtrail.functions import content as C
from blobtrail.functions import fingerprints as FP
from blobtrail.functions import tokens as T
from blobtrail.plans import sqlfrag as S
from blobtrail.plans.oracle_views import blob_sql, with_views
from blobtrail.plans.registry import register
from blobtrail.session import written
from blobtrail.sources.testdata import CHAIN_STEP, Repo

K = T.DEFAULT_K
N = T.DEFAULT_N
W = T.DEFAULT_WINDOW
P = FP.DEFAULT_PERM
LF = "chr(10)"


def _digest_sorted(arr: Column) -> Column:
    return F.sha1(F.array_join(F.array_sort(F.transform(arr, lambda x: x.cast("string"))), "\n"))


def _digest_list(arr: Column, sep: str = "\n") -> Column:
    return F.sha1(F.array_join(F.transform(arr, lambda x: x.cast("string")), sep))


def _docs_tokens(repo: Repo) -> DataFrame:
    d = repo.spread("documents", "doc_id").select("doc_id", "text")
    return T.with_array(d, "tok", T.tokenize(F.col("text")))


# --- B1-B4 -------------------------------------------------------------------


@register("blob_id", "B3", with_views("file_versions") + "SELECT commit_id, blob_id, octet_length(encode(content)) AS n_bytes FROM file_versions")
def q_blob_id(repo: Repo) -> DataFrame:
    fv = repo.file_versions()
    return fv.select("commit_id", "blob_id", F.octet_length(C.as_bytes(F.col("content"))).alias("n_bytes"))


@register(
    "normalize_lf",
    "B1",
    with_views("file_versions")
    + f"SELECT commit_id, octet_length(encode(lf)) AS n_bytes_lf, {blob_sql('lf')} AS blob_lf "
    + "FROM (SELECT commit_id, regexp_replace(content, '\\r\\n?', chr(10), 'g') AS lf FROM file_versions)",
)
def q_normalize_lf(repo: Repo) -> DataFrame:
    fv = repo.file_versions().withColumn("lf", C.normalize_lf(F.col("content")))
    return fv.select("commit_id", F.octet_length(C.as_bytes(F.col("lf"))).alias("n_bytes_lf"), C.blob_id(F.col("lf")).alias("blob_lf"))


@register("decode_ignore", "B2", "SELECT doc_id, length(text) AS n_chars, sha1(text) AS digest FROM documents")
def q_decode_ignore(repo: Repo) -> DataFrame:
    """Binary content with undecodable bytes around the text decodes back to
    the text itself."""
    d = repo.table("documents")
    raw = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    dec = C.decode_ignore(raw, BinaryType())
    return d.select("doc_id", F.length(dec).alias("n_chars"), F.sha1(F.encode(dec, "UTF-8")).alias("digest"))


@register(
    "blob_ids_lf_crlf",
    "B4",
    with_views("query_files")
    + f"SELECT query_id, {blob_sql('content')} AS blob_norm, {blob_sql(f'replace(content, {LF}, chr(13) || {LF})')} AS blob_raw FROM query_files",
)
def q_blob_ids(repo: Repo) -> DataFrame:
    q = repo.query_files()
    norm, raw = C.blob_ids_lf_crlf(F.col("content"))
    return q.select("query_id", norm.alias("blob_norm"), raw.alias("blob_raw"))


# --- B5-B11 ------------------------------------------------------------------


@register(
    "split_identifier",
    "B5",
    f"SELECT conv_id, turn, len(t) AS n_tokens, {S.list_digest('t', "' '")} AS digest "
    f"FROM (SELECT conv_id, turn, {S.tokens('text')} AS t FROM conversations)",
)
def q_split_identifier(repo: Repo) -> DataFrame:
    c = repo.table("conversations")
    t = T.split_identifier(F.coalesce(F.col("text"), F.lit("")))
    return c.select("conv_id", "turn", t.alias("t")).select(
        "conv_id", "turn", F.size("t").alias("n_tokens"), _digest_list(F.col("t"), " ").alias("digest")
    )


@register(
    "tokenize",
    "B6",
    f"SELECT doc_id, len(t) AS n_tokens, {S.list_digest('t', "' '")} AS digest FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents)",
)
def q_tokenize(repo: Repo) -> DataFrame:
    d = _docs_tokens(repo)
    return d.select("doc_id", F.size("tok").alias("n_tokens"), _digest_list(F.col("tok"), " ").alias("digest"))


@register(
    "shingles",
    "B7",
    f"SELECT doc_id, len(s) AS n_shingles, {S.list_digest('s')} AS digest "
    f"FROM (SELECT doc_id, {S.shingles('t', 3)} AS s FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents))",
)
def q_shingles(repo: Repo) -> DataFrame:
    d = _docs_tokens(repo).withColumn("s", T.shingles(F.col("tok"), 3))
    return d.select("doc_id", F.size("s").alias("n_shingles"), _digest_list(F.col("s")).alias("digest"))


@register(
    "shingle_set",
    "B8",
    f"SELECT doc_id, len(s) AS n_distinct, {S.set_digest('s')} AS digest "
    f"FROM (SELECT doc_id, list_distinct({S.shingles('t', K)}) AS s FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents))",
)
def q_shingle_set(repo: Repo) -> DataFrame:
    d = _docs_tokens(repo).withColumn("s", T.shingle_set(F.col("tok"), K))
    return d.select("doc_id", F.size("s").alias("n_distinct"), _digest_sorted(F.col("s")).alias("digest"))


@register(
    "stable_hash64",
    "B9",
    f"SELECT doc_id, {S.hex16('st')} AS hash_hex, {S.signed(S.u64(S.hex16('st')))} AS hash_long "
    f"FROM (SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS st FROM documents)",
)
def q_stable_hash64(repo: Repo) -> DataFrame:
    d = _docs_tokens(repo).withColumn("st", T.token_stream(F.col("tok")))
    return d.select("doc_id", T.hash64_hex(F.col("st")).alias("hash_hex"), T.hash64(F.col("st")).alias("hash_long"))


@register(
    "token_stream",
    "B10",
    f"SELECT doc_id, length(st) AS n_chars, sha1(st) AS digest FROM (SELECT doc_id, array_to_string({S.tokens('text')}, ' ') AS st FROM documents)",
)
def q_token_stream(repo: Repo) -> DataFrame:
    d = _docs_tokens(repo).withColumn("st", T.token_stream(F.col("tok")))
    return d.select("doc_id", F.length("st").alias("n_chars"), F.sha1(F.encode("st", "UTF-8")).alias("digest"))


@register(
    "char_ngrams",
    "B11",
    f"SELECT doc_id, len(g) AS n_distinct, {S.set_digest('g')} AS digest "
    f"FROM (SELECT doc_id, {S.char_ngrams('st', N, 'chars')} AS g FROM {S.features('doc_id', 'text', 'documents', K)})",
)
def q_char_ngrams(repo: Repo) -> DataFrame:
    d = T.with_array(_docs_tokens(repo), "g", FP.gram_strings(T.token_stream(F.col("tok")), N))
    return d.select("doc_id", F.size("g").alias("n_distinct"), F.sha1(F.array_join("g", "\n")).alias("digest"))


# --- fingerprints per document (E2, E4, E6) ------------------------------------


def doc_fingerprint(repo: Repo, kind: str) -> DataFrame:
    """(doc_id, fp) of every document: ``sset`` distinct shingles, ``win``
    winnowing values, ``simhash`` or ``sig`` (MinHash). Only the one asked for is
    computed."""
    d = _docs_tokens(repo)
    if kind == "sset":
        d = d.withColumn("fp", T.shingle_set(F.col("tok"), K))
    elif kind == "win":
        d = T.with_array(d, "shx", FP.shingle_hex(T.shingles(F.col("tok"), K)))
        d = d.withColumn("fp", FP.winnow_from_hex("shx", W))
    elif kind == "simhash":
        d = d.withColumn("fp", FP.simhash_of_tokens(F.col("tok")))
    else:
        d = d.withColumn("fp", FP.minhash_of_tokens(F.col("tok"), K, P))
    return d.select("doc_id", "fp")


_SSET_SQL = f"src AS (SELECT doc_id, list_distinct({S.shingles('t', K)}) AS s FROM (SELECT doc_id, {S.tokens('text')} AS t FROM documents))"
_SIGS_SQL = f"WITH {_SSET_SQL}," + S.minhash_cte("src", "doc_id", "s", P).lstrip()


@register("minhash_signature", "E2", _SIGS_SQL + f"\nSELECT doc_id, {S.list_digest('sig', "','")} AS digest, sig[1] AS first_value FROM mh")
def q_minhash_signature(repo: Repo) -> DataFrame:
    f = T.with_array(doc_fingerprint(repo, "sig"), "fp", F.col("fp"))
    return f.select("doc_id", _digest_list(F.col("fp"), ",").alias("digest"), F.col("fp")[0].alias("first_value"))


@register(
    "simhash64",
    "E4",
    "WITH src AS (SELECT doc_id, " + S.tokens("text") + " AS tok FROM documents)," + S.simhash_cte("src", "doc_id", "tok").lstrip()
    + f"\nSELECT doc_id, {S.hex_of('u')} AS simhash_hex FROM sh",
)
def q_simhash64(repo: Repo) -> DataFrame:
    f = doc_fingerprint(repo, "simhash")
    return f.select("doc_id", T.long_to_hex(F.col("fp")).alias("simhash_hex"))


@register(
    "winnow_fingerprint",
    "E6",
    f"SELECT doc_id, len(w) AS n_values, {S.set_digest('w')} AS digest FROM ("
    f"SELECT doc_id, {S.winnow('hx', W)} AS w FROM ("
    f"SELECT doc_id, list_transform({S.shingles('t', K)}, lambda s: {S.hex16('s')}) AS hx FROM ("
    f"SELECT doc_id, {S.tokens('text')} AS t FROM documents)))",
)
def q_winnow(repo: Repo) -> DataFrame:
    f = T.with_array(doc_fingerprint(repo, "win"), "fp", F.col("fp"))
    return f.select("doc_id", F.size("fp").alias("n_values"), _digest_sorted(F.col("fp")).alias("digest"))


# --- pair scores: each document against its chain parent (doc_id - 20) --------


def _parent_pairs(repo: Repo, kind: str) -> DataFrame:
    """(doc_id, parent_id, fp, p_fp); both sides read one written table."""
    f = written(doc_fingerprint(repo, kind))
    par = f.select(F.col("doc_id").alias("parent_id"), F.col("fp").alias("p_fp"))
    return f.join(par, f.doc_id - CHAIN_STEP == par.parent_id)


def _pair_sql(set_expr: str) -> str:
    """Score of each document against its chain parent, counted by joining
    the two exploded sets on the item (no list intersection)."""
    return f"""WITH fp AS (SELECT doc_id, {set_expr} AS s FROM {S.features('doc_id', 'text', 'documents', K)}),
g AS (SELECT doc_id, unnest(s) AS item FROM fp),
pairs AS (SELECT a.doc_id, b.doc_id AS parent_id FROM documents a JOIN documents b ON a.doc_id - {CHAIN_STEP} = b.doc_id),
i AS (SELECT p.doc_id, count(*) AS inter FROM pairs p JOIN g a ON a.doc_id = p.doc_id JOIN g b ON b.doc_id = p.parent_id AND b.item = a.item GROUP BY 1)
SELECT p.doc_id, p.parent_id, round(CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0
       ELSE coalesce(i.inter, 0) / (len(a.s) + len(b.s) - coalesce(i.inter, 0)) END, 6) AS score
FROM pairs p JOIN fp a ON a.doc_id = p.doc_id JOIN fp b ON b.doc_id = p.parent_id LEFT JOIN i ON i.doc_id = p.doc_id"""


_SETS = {m: f(K, N, W) for m, f in S.SET_EXPR.items()}


@register("jaccard", "E1", _pair_sql(_SETS["jaccard"]))
def q_jaccard(repo: Repo) -> DataFrame:
    p = _parent_pairs(repo, "sset")
    return p.select("doc_id", "parent_id", F.round(FP.jaccard(F.col("fp"), F.col("p_fp")), 6).alias("score"))


@register("charjaccard_score", "E7", _pair_sql(_SETS["charjaccard"]))
def q_charjaccard(repo: Repo) -> DataFrame:
    """The n-grams of a text take several times its room, so token streams are
    joined and the sets made where two of them are compared."""
    d = repo.spread("documents", "doc_id").select("doc_id", FP.stream_of_text(T.nfkc(F.col("text"))).alias("st"))
    par = d.select(F.col("doc_id").alias("parent_id"), F.col("st").alias("p_st"))
    p = d.join(par, d.doc_id - CHAIN_STEP == par.parent_id)
    return p.select("doc_id", "parent_id", F.round(FP.gram_jaccard(F.col("st"), F.col("p_st"), N), 6).alias("score"))


@register("winnow_score", "E7", _pair_sql(_SETS["winnow"]))
def q_winnow_score(repo: Repo) -> DataFrame:
    p = _parent_pairs(repo, "win")
    return p.select("doc_id", "parent_id", F.round(FP.jaccard(F.col("fp"), F.col("p_fp")), 6).alias("score"))


_SIM_SRC = (
    "WITH src AS (SELECT doc_id, " + S.tokens("text") + " AS tok FROM documents)," + S.simhash_cte("src", "doc_id", "tok").lstrip()
    + f",\npairs AS (SELECT a.doc_id, b.doc_id AS parent_id FROM documents a JOIN documents b ON a.doc_id - {CHAIN_STEP} = b.doc_id)"
)


@register(
    "hamming64",
    "B12",
    _SIM_SRC + "\nSELECT p.doc_id, p.parent_id, bit_count(xor(a.u, b.u)) AS hamming FROM pairs p JOIN sh a ON a.doc_id = p.doc_id JOIN sh b ON b.doc_id = p.parent_id",
)
def q_hamming(repo: Repo) -> DataFrame:
    p = _parent_pairs(repo, "simhash")
    return p.select("doc_id", "parent_id", T.hamming64(F.col("fp"), F.col("p_fp")).alias("hamming"))


@register(
    "simhash_similarity",
    "E5",
    _SIM_SRC + "\nSELECT p.doc_id, p.parent_id, round(1 - bit_count(xor(a.u, b.u)) / 64.0, 6) AS score FROM pairs p JOIN sh a ON a.doc_id = p.doc_id JOIN sh b ON b.doc_id = p.parent_id",
)
def q_simhash_similarity(repo: Repo) -> DataFrame:
    p = _parent_pairs(repo, "simhash")
    return p.select("doc_id", "parent_id", F.round(FP.simhash_similarity(F.col("fp"), F.col("p_fp")), 6).alias("score"))


@register(
    "minhash_similarity",
    "E3",
    _SIGS_SQL
    + f""",
e AS (SELECT doc_id, unnest(sig) AS v, unnest(range({P})) AS i FROM mh)
SELECT a.doc_id, b.doc_id AS parent_id, round(count(*) FILTER (WHERE a.v = b.v) / {P}.0, 6) AS score
FROM e a JOIN e b ON a.doc_id - {CHAIN_STEP} = b.doc_id AND a.i = b.i GROUP BY 1, 2""",
)
def q_minhash_similarity(repo: Repo) -> DataFrame:
    p = _parent_pairs(repo, "sig")
    return p.select("doc_id", "parent_id", F.round(FP.minhash_similarity(F.col("fp"), F.col("p_fp")), 6).alias("score"))
