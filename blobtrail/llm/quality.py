"""Operator 7: quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are
compared, by Jensen-Shannon distance (square root of the divergence, base 2,
so 0 to 1), to reference histograms of its language. The references are sums
over every document of the language that passes the base rules, so they grow
with the corpus; only one row per language is kept of them. Documents below
``min_words`` fail the base rules and languages with fewer than
``min_reference_words`` reference words judge nobody (the minimum-length
guards). Everything is built-in DataFrame expressions.

The word distance is limited by length and language: a document of n words
drawn from its language's reference lies at an expected distance, with a
spread, that the reference's shares give; what lies ``SPREADS`` spreads beyond
goes, so documents without common words or in another language go from about
100 words on, and shorter ones, which chance could make so, stay.

Cases: null text counts as empty (0 words, base_failed). A null language is a
language of its own. Repeated rows each come back. Null ids come back null.
An empty table gives an empty result. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import WORD, once, small, table, written

# --- fixed values ----------------------------------------------------------
# Character classes: each character falls in the first class that holds it.
CHAR_CLASSES = {
    "lower": "a-z",
    "upper": "A-Z",
    "digit": "0-9",
    "space": r"\x20\x09-\x0D",
    "symbol": "#*$%&|<>",
}
# Frequent function words of English, German, French and Spanish.
COMMON_WORDS = ["the", "of", "and", "to", "der", "die", "und", "zu", "de", "la", "le", "et", "les", "el", "en", "que"]
# Limits: Jensen-Shannon distance beyond which a document is rejected, the
# shortest judged document and the smallest reference, both in words.
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.45
MIN_WORDS = 50
MIN_REFERENCE_WORDS = 2000
# The word limit: spreads beyond the distance expected of n words (a
# chance of about 1e-4 for a clean document), and the least limit, which
# leaves room for style in long documents.
SPREADS = 7
LEAST_WORD_DISTANCE = 0.12
# References are broadcast up to so many languages (about 250 bytes each).
MAX_BROADCAST_LANGS = 10_000
# ---------------------------------------------------------------------------


def _kept_chars(text: Column, cls: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{cls}]+", "")).cast("long")


def _array_sum(a: Column, kind: str = "long") -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x)


def _rest(a: str, start: int) -> Column:
    return F.slice(a, F.lit(start), F.greatest(F.size(a) - (start - 1), F.lit(0)))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the word hashes ``_x``: words inside 3-word
    windows that occur at least twice in the text. Window hashes are sorted
    with their positions, so equal ones are neighbours, in n log n."""
    pairs = F.zip_with("_x", _rest("_x", 2), lambda a, b: F.xxhash64(a, b))
    tri = F.zip_with(pairs, _rest("_x", 3), lambda a, b: F.xxhash64(a, b))
    df = once(df, "_h", F.slice(tri, F.lit(1), F.greatest(F.size("_x") - 2, F.lit(0))))
    order = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = once(df, "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), order))
    twice = F.zip_with("_s", _rest("_s", 2), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.sort_array(F.array_distinct(F.flatten(F.array_compact(twice))))
    df = once(df, "_p", places)
    steps = F.zip_with("_p", _rest("_p", 2), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3)).cast("long"))
    return df.withColumn("n_repeat_words", F.coalesce(_array_sum(steps), F.lit(0).cast("long"))).drop("_h", "_s", "_p")


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", whole_rows: bool = False) -> DataFrame:
    """One row per document: counts of the base rules and the two histograms
    (arrays of counts); no shuffle. ``whole_rows`` carries the input row
    along as struct ``row`` (in place of the id alone)."""
    carried = F.struct(*[docs[c] for c in docs.columns]).alias("row") if whole_rows else F.col(id_col).alias("doc_id")
    key = "row" if whole_rows else "doc_id"
    d = docs.select(carried, F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.when(F.col("text").rlike(WORD), F.split(F.trim("text", F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))
    d = once(d, "_x", F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.xxhash64(w)))
    d = _repeat_words(d)
    common = [F.xxhash64(F.lit(v)) for v in COMMON_WORDS]
    d = once(d, "_c", F.filter("_x", lambda x: x.isin(*common)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    d = once(d, "_l", lines)
    chars = [_kept_chars(F.col("text"), c) for c in CHAR_CLASSES.values()]
    d = once(d, "_ch", F.array(*chars))
    d = d.select(
        key,
        "lang",
        F.size("_x").cast("long").alias("n_words"),
        F.length("text").cast("long").alias("_len"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        "_ch",
        F.array(*[(F.size("_c") - F.size(F.array_remove("_c", h))).cast("long") for h in common]).alias("_wh"),
    )
    d = once(d, "_wh", F.col("_wh"))
    return d.select(
        key,
        "lang",
        "n_words",
        (F.col("_len") - F.get("_ch", F.lit(list(CHAR_CLASSES).index("space")))).alias("word_chars"),
        F.get("_ch", F.lit(list(CHAR_CLASSES).index("symbol"))).alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.concat("_ch", F.array(F.col("_len") - _array_sum(F.col("_ch")))).alias("char_hist"),
        F.concat("_wh", F.array(F.col("n_words") - _array_sum(F.col("_wh")))).alias("word_hist"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(feats: DataFrame) -> DataFrame:
    """One row per language: histogram sums over its documents that pass the
    base rules (partial sums before the shuffle)."""
    ok = feats.where(~F.col("base_failed"))
    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in range(len(CHAR_CLASSES) + 1)]
    sums += [F.sum(F.get("word_hist", F.lit(i))).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]
    g = ok.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *sums)
    return g.select(
        F.col("lang").alias("ref_lang"),
        "ref_words",
        F.array(*[f"c{i}" for i in range(len(CHAR_CLASSES) + 1)]).alias("ref_char"),
        F.array(*[f"w{i}" for i in range(len(COMMON_WORDS) + 1)]).alias("ref_word"),
    )


def js_distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two count histograms; null where one is
    all zero."""

    def share(h):
        total = _array_sum(h).cast("double")
        return F.transform(h, lambda x: x / total)

    def part(p, q):
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    both = F.zip_with(share(a), share(b), lambda p, q: (part(p, q) + part(q, p)) / 2)
    ok = (_array_sum(a) > 0) & (_array_sum(b) > 0)
    return F.when(ok, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))))


def word_limit(ref: Column, n_words: Column) -> Column:
    """Largest word distance of a document of n words from its language's
    histogram ``ref``. Sampling gives a class of share q an expected part
    (1 - q) / (8 n ln 2) of the divergence, q at most (a class that is not
    drawn), as a scaled chi-square of one degree."""
    total = _array_sum(ref).cast("double")
    parts = F.transform(ref, lambda x: F.least((1 - x / total) / (n_words * (8 * math.log(2))), x / total))
    squares = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x * x)
    limit = F.sqrt(_array_sum(parts, "double") + SPREADS * F.sqrt(2 * squares))
    return F.least(F.lit(MAX_WORD_DISTANCE), F.greatest(F.lit(LEAST_WORD_DISTANCE), limit))


def verdict(feats: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds both distances and ``kept`` to feature rows."""
    j = feats.join(small(refs, MAX_BROADCAST_LANGS), feats["lang"] == refs["ref_lang"], "left")
    j = j.withColumn("char_distance", js_distance(F.col("char_hist"), F.col("ref_char")))
    j = j.withColumn("word_distance", js_distance(F.col("word_hist"), F.col("ref_word")))
    judged = (F.col("n_words") >= MIN_WORDS) & (F.coalesce(F.col("ref_words"), F.lit(0)) >= MIN_REFERENCE_WORDS)
    most = F.when(judged, word_limit(F.col("ref_word"), F.col("n_words")))
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > F.coalesce(most, F.lit(MAX_WORD_DISTANCE)))
    return j.withColumn("kept", ~F.col("base_failed") & ~(judged & far))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = written(features(table(spark, sf_dir, "documents")))
    return verdict(feats, written(references(feats))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that the rules reject go. Texts are read twice
    (references, then verdicts) and never shuffled."""
    refs = written(references(features(docs)))
    return verdict(features(docs, whole_rows=True), refs).where("kept").select("row.*")


def _oracle() -> str:
    """The whole query in DuckDB SQL, from the same fixed values."""
    chars = ", ".join(f"length(regexp_replace(text, '[^{cls}]', '', 'g'))" for cls in CHAR_CLASSES.values())
    words = ", ".join(f"len(list_filter(w, lambda x: x = '{v}'))" for v in COMMON_WORDS)
    sums = lambda col, n: "[" + ", ".join(f"sum({col}[{i + 1}])" for i in range(n + 1)) + "]"
    space, symbol = (list(CHAR_CLASSES).index(k) + 1 for k in ("space", "symbol"))

    def distance(a: str, b: str) -> str:
        p, q = f"({a}[i] / list_sum({a})::DOUBLE)", f"({b}[i] / list_sum({b})::DOUBLE)"
        part = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
        total = f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: (({part(p, q)}) + ({part(q, p)})) / 2))"
        return f"CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, {total})) ELSE 0 END"

    # Expected parts of a class of share q at n words, as in ``word_limit``.
    part = f"least((1 - x / list_sum(rw)::DOUBLE) / (n_words * {8 * math.log(2)!r}), x / list_sum(rw)::DOUBLE)"
    parts = f"list_transform(rw, lambda x: {part})"
    limit = f"sqrt(list_sum({parts}) + {SPREADS} * sqrt(2 * list_sum(list_transform({parts}, lambda y: y * y))))"
    limit = f"CASE WHEN n_words >= {MIN_WORDS} AND ref_words >= {MIN_REFERENCE_WORDS} THEN least({MAX_WORD_DISTANCE}, greatest({LEAST_WORD_DISTANCE}, {limit})) ELSE {MAX_WORD_DISTANCE} END"

    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), c AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM x) WHERE k > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), h AS (
  SELECT doc_id, lang, len(w) AS n_words, length(text) AS n_chars, [{chars}] AS ch, [{words}] AS wh FROM d
), f AS (
  SELECT h.doc_id, lang, n_words, n_chars - ch[{space}] AS word_chars, ch[{symbol}] AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    list_append(ch, n_chars - list_sum(ch)) AS ch, list_append(wh, n_words - list_sum(wh)) AS wh,
    n_words < 50 OR 100 * coalesce(c.n, 0) > 50 * n_words AS base_failed
  FROM h LEFT JOIN l ON l.doc_id = h.doc_id LEFT JOIN c ON c.doc_id = h.doc_id
), r AS (
  SELECT lang, sum(n_words) AS ref_words, {sums("ch", len(CHAR_CLASSES))} AS rc, {sums("wh", len(COMMON_WORDS))} AS rw FROM f WHERE NOT base_failed GROUP BY lang
), j AS (
  SELECT f.*, rw, coalesce(r.ref_words, 0) AS ref_words, {distance("ch", "rc")} AS cd, {distance("wh", "rw")} AS wd FROM f LEFT JOIN r ON r.lang = f.lang
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND ref_words >= {MIN_REFERENCE_WORDS} AND (cd > {MAX_CHAR_DISTANCE} OR wd > {limit})) AS kept
FROM j
"""


ORACLE_SQL = _oracle()
