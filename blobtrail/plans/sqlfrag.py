"""DuckDB SQL fragments for the oracle queries (tokenizer, shingles, hashes).
Written from the operator definitions, independent of the Spark code."""

from __future__ import annotations

from blobtrail.functions.fingerprints import minhash_params


def tokens(text: str) -> str:
    """B6 without NFKC (DuckDB has none; the test data is NFKC-stable).
    The acronym look-ahead is rewritten as a space insertion."""
    spaced = f"regexp_replace(coalesce({text}, ''), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_transform(regexp_extract_all({spaced}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"


def shingles(tok: str, k: int) -> str:
    if k <= 1:
        return tok
    return (
        f"(CASE WHEN len({tok}) = 0 THEN []::VARCHAR[] WHEN len({tok}) < {k} THEN [array_to_string({tok}, ' ')] "
        f"ELSE list_transform(range(1, len({tok}) - {k} + 2), lambda i: array_to_string({tok}[i:i + {k - 1}], ' ')) END)"
    )


def hex16(s: str) -> str:
    return f"substr(sha1({s}), 1, 16)"


def u64(hex_expr: str) -> str:
    return f"('0x' || {hex_expr})::UBIGINT"


def signed(u: str) -> str:
    """Unsigned 64-bit value -> the BIGINT with the same bits."""
    return f"CAST(CASE WHEN ({u})::HUGEINT >= 9223372036854775808 THEN ({u})::HUGEINT - 18446744073709551616 ELSE ({u})::HUGEINT END AS BIGINT)"


def hex_of(u: str) -> str:
    return f"lpad(lower(hex(({u})::UBIGINT)), 16, '0')"


def char_ngrams(stream: str, n: int, chars: str | None = None) -> str:
    """Distinct character n-grams of ``stream`` (``chars`` is accepted for
    list-based variants; substr is the faster form in DuckDB)."""
    chars = chars or f"string_split({stream}, '')"
    if n <= 1:
        return f"(CASE WHEN length({stream}) = 0 THEN []::VARCHAR[] ELSE list_distinct({chars}) END)"
    return (
        f"(CASE WHEN length({stream}) = 0 THEN []::VARCHAR[] WHEN length({stream}) < {n} THEN [{stream}] "
        f"ELSE list_distinct(list_transform(range(1, length({stream}) - {n} + 2), lambda i: substr({stream}, i, {n}))) END)"
    )


def features(keys: str, text: str, src: str, k: int = 5) -> str:
    """Derived table with ``keys``, tok, st (token stream), chars and hx
    (ordered shingle hashes), each computed once per row: lambdas below
    read these columns per position and must not recompute them."""
    return (
        f"(SELECT *, list_transform({shingles('tok', k)}, lambda x: {hex16('x')}) AS hx, string_split(st, '') AS chars FROM "
        f"(SELECT *, array_to_string(tok, ' ') AS st FROM (SELECT {keys}, {tokens(text)} AS tok FROM {src})))"
    )


SET_EXPR = {
    "jaccard": lambda k, n, w: f"list_distinct({shingles('tok', k)})",
    "charjaccard": lambda k, n, w: char_ngrams("st", n, "chars"),
    "winnow": lambda k, n, w: winnow("hx", w),
}


def winnow(hx: str, w: int) -> str:
    return (
        f"(CASE WHEN len({hx}) = 0 THEN []::VARCHAR[] WHEN len({hx}) <= {w} THEN [list_min({hx})] "
        f"ELSE list_distinct(list_transform(range(1, len({hx}) - {w} + 2), lambda i: list_min({hx}[i:i + {w - 1}]))) END)"
    )


def set_digest(arr: str) -> str:
    """sha1 of the sorted, newline-joined elements (as text)."""
    return f"sha1(array_to_string(list_sort(list_transform({arr}, lambda x: CAST(x AS VARCHAR))), chr(10)))"


def list_digest(arr: str, sep: str = "chr(10)") -> str:
    return f"sha1(array_to_string(list_transform({arr}, lambda x: CAST(x AS VARCHAR)), {sep}))"


def minhash_value(a: int, b: int) -> str:
    """(a * x + b) mod 2^64 for x = xh * 2^32 + xl, in unsigned 64-bit steps
    that never overflow."""
    m = "4294967295::UBIGINT"
    (ah, al), (bh, bl) = divmod(a, 1 << 32), divmod(b, 1 << 32)
    lo = f"({al}::UBIGINT * xl + {bl}::UBIGINT)"
    hi = f"((({lo} >> 32) + (({al}::UBIGINT * xh) & {m}) + (({ah}::UBIGINT * xl) & {m}) + {bh}::UBIGINT) & {m})"
    return f"{hi} * 4294967296::UBIGINT + ({lo} & {m})"


def minhash_cte(src: str, key: str, set_col: str, num_perm: int, name: str = "mh") -> str:
    """CTE ``name``(key, sig BIGINT[] of signed values) from ``src`` rows
    holding a distinct shingle list ``set_col``; empty sets give zeros."""
    mins = ", ".join(f"min({minhash_value(a, b)}) AS v{i}" for i, (a, b) in enumerate(zip(*minhash_params(num_perm), strict=True)))
    sig = ", ".join(signed(f"v{i}") for i in range(num_perm))
    return f"""
{name}_x AS (SELECT k, ('0x' || substr(h, 1, 8))::UBIGINT AS xh, ('0x' || substr(h, 9, 8))::UBIGINT AS xl
             FROM (SELECT {key} AS k, sha1(s) AS h FROM (SELECT {key}, unnest({set_col}) AS s FROM {src}))),
{name}_v AS (SELECT k, {mins} FROM {name}_x GROUP BY k),
{name}_s AS (SELECT k, [{sig}] AS sig FROM {name}_v),
{name} AS (SELECT s.{key} AS {key}, coalesce(m.sig, list_transform(range({num_perm}), lambda i: 0::BIGINT)) AS sig
           FROM {src} s LEFT JOIN {name}_s m ON m.k = s.{key})"""


def simhash_cte(src: str, key: str, tok_col: str, name: str = "sh") -> str:
    """CTE ``name``(key, u UBIGINT) SimHash over tokens with repeats."""
    return f"""
{name}_t AS (SELECT {key} AS k, {u64(hex16('t'))} AS u FROM (SELECT {key}, unnest({tok_col}) AS t FROM {src})),
{name}_b AS (SELECT k, bit, sum(CASE WHEN (u >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS acc FROM {name}_t, range(64) AS r(bit) GROUP BY k, bit),
{name}_v AS (SELECT k, bit_or(CASE WHEN acc > 0 THEN CAST(pow(2, bit) AS UBIGINT) ELSE 0::UBIGINT END) AS u FROM {name}_b GROUP BY k),
{name} AS (SELECT s.{key} AS {key}, coalesce(v.u, 0::UBIGINT) AS u FROM {src} s LEFT JOIN {name}_v v ON v.k = s.{key})"""
