"""Token, shingle and n-gram column expressions.

Everything is a built-in expression except Unicode NFKC, which Spark lacks:
it runs in an Arrow-batched pandas UDF that only receives the rows holding a
character NFKC can change (all other rows pass a null, so Arrow moves almost
nothing for ASCII / Latin-1 text)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values (must equal the reference's tokenizer) -------------------
# Identifier split pattern, applied to the whole text. Acronym before a
# capitalised word, optional capital + lowercase run, capital run, digit run.
# Underscores and every non-ASCII character separate tokens.
TOKEN_PATTERN = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
# Characters NFKC can never change on their own: ASCII and the Latin-1
# letters U+00C0-U+00FF (already composed, no compatibility mapping).
NFKC_STABLE = "\\x00-\\x7F\\xC0-\\xFF"
# Defaults: shingle size, char n-gram size, winnow window.
DEFAULT_K = 5
DEFAULT_N = 5
DEFAULT_WINDOW = 4
# ---------------------------------------------------------------------------


def with_array(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Adds column ``name`` = ``expr``, computed once per row.

    Array columns here are read inside lambdas once per position (shingles,
    n-grams, winnow windows). If Catalyst inlined the producing expression
    into such a lambda, a whole document would be re-tokenised per position
    (quadratic). A one-element explode (a Generate node) keeps the value a
    materialised attribute; it adds no shuffle and no extra rows."""
    cols = [c for c in df.columns if c != name]
    return df.select(*cols, F.explode(F.array(expr)).alias(name))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC-normalise a string column, calling Python only for rows with a
    character outside the stable set."""
    needs = text.rlike(f"[^{NFKC_STABLE}]")
    return F.coalesce(_nfkc(F.when(needs, text)), text)


def split_identifier(text: Column) -> Column:
    """Identifier parts, lower-cased, in order."""
    parts = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)
    return F.transform(parts, lambda p: F.lower(p))


def tokenize(text: Column, normalize: bool = True) -> Column:
    """NFKC, then identifier parts of every [A-Za-z0-9_] run. Splitting the
    whole text at once equals splitting run by run: every alternative of the
    pattern lives inside [A-Za-z0-9] and its look-ahead reads only letters."""
    src = nfkc(text) if normalize else text
    return split_identifier(F.coalesce(src, F.lit("")))


def shingles(tokens: Column, k: int = DEFAULT_K) -> Column:
    """Contiguous k-grams joined by one space (k<=1: the tokens; fewer
    than k tokens: one shingle of all of them; none: empty)."""
    n = F.size(tokens)
    if k <= 1:
        return tokens
    windows = F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n < k, F.array(F.array_join(tokens, " ")))
        .otherwise(windows)
    )


def shingle_set(tokens: Column, k: int = DEFAULT_K) -> Column:
    """Distinct shingles."""
    return F.array_distinct(shingles(tokens, k))


def hash64_hex(s: Column) -> Column:
    """B9 (hex form): first 8 bytes of SHA-1 as 16 lowercase hex digits.
    String order of this form equals unsigned 64-bit order."""
    return F.substring(F.sha1(F.encode(s, "UTF-8")), 1, 16)


def hex_to_long(h: Column) -> Column:
    """Same 64 bits as a signed long (two's complement)."""
    return F.conv(h, 16, -10).cast("long")


def hash64(s: Column) -> Column:
    """Stable 64-bit hash as a signed long holding the unsigned bits."""
    return hex_to_long(hash64_hex(s))


def long_to_hex(c: Column) -> Column:
    """Signed long -> 16 lowercase hex digits of its unsigned bits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def token_stream(tokens: Column) -> Column:
    """Tokens joined by single spaces."""
    return F.array_join(tokens, " ")


def char_ngrams(stream: Column, n: int = DEFAULT_N, chars: Column | None = None) -> Column:
    """Distinct character n-grams of a token stream (n<=1: distinct
    characters; shorter than n: the stream itself; empty: empty).

    ``chars`` should be a column holding ``split(stream, '')`` computed once
    (a projected column, not an inline expression): the lambda reads it per
    position, and ``substring`` per position would rescan the string from
    its start every time."""
    if chars is None:
        chars = F.split(stream, "")
    length = F.size(chars)
    size = max(1, n)
    grams = F.array_distinct(
        F.transform(F.sequence(F.lit(1), length - size + 1), lambda i: F.array_join(F.slice(chars, i, size), ""))
    )
    return (
        F.when(F.length(stream) == 0, F.array().cast("array<string>"))
        .when(F.lit(n <= 1) | (length >= size), grams)
        .otherwise(F.array(stream))
    )


def hamming64(a: Column, b: Column) -> Column:
    """Popcount of XOR."""
    return F.bit_count(a.bitwiseXOR(b))
