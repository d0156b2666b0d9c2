"""Fingerprints: MinHash (E2), SimHash (E4), winnowing (E6) and the pairwise
scores E1, E3, E5 as column expressions.

64-bit unsigned values are carried as signed ``long`` holding the same bits.
MinHash needs a wrapping unsigned 64-bit multiply, which ANSI-mode ``long``
arithmetic refuses. ``minhash_terms`` states it by limbs that never overflow,
as minima over exploded hashes (generated JVM code; ``with_minhash`` in
``fingerprint_tables`` is its table form); ``minhash_signature`` is the same as
an Arrow-batched numpy UDF over each row's hash array, where a column expression
is wanted. SimHash and winnowing are higher-order array expressions, row-local,
no shuffle.

The ``*_of_tokens`` and ``gram*`` forms compute the same from token arrays in
Arrow batches with numpy, ``SLICE`` tokens at a time: what a lambda of Spark
evaluates per position is one array operation there."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from blobtrail.functions.tokens import DEFAULT_WINDOW, hash64_hex

# --- fixed values (must equal the reference's MinHash family) --------------
# Parameters come from Python's Mersenne Twister seeded with 42: for each
# permutation draw a = getrandbits(64) | 1, then b = getrandbits(64).
MINHASH_SEED = 42
DEFAULT_PERM = 128
# ---------------------------------------------------------------------------
_CHUNK = 4096


@lru_cache(maxsize=16)
def minhash_params(num_perm: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Multipliers (odd) and offsets of the family."""
    draws = np.array([*map(random.Random(MINHASH_SEED).getrandbits, [64] * (2 * num_perm))], dtype=np.uint64).reshape(num_perm, 2)
    return tuple((draws[:, 0] | np.uint64(1)).tolist()), tuple(draws[:, 1].tolist())


def _signature_fn(num_perm: int):
    a_list, b_list = minhash_params(num_perm)
    a = np.array(a_list, dtype=np.uint64)[:, None]
    b = np.array(b_list, dtype=np.uint64)[:, None]
    top = np.iinfo(np.uint64).max

    def one(arr) -> np.ndarray:
        if arr is None or len(arr) == 0:
            return np.zeros(num_perm, dtype=np.int64)
        x = np.asarray(arr, dtype=np.int64).view(np.uint64)
        best = np.full(num_perm, top, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for s in range(0, len(x), _CHUNK):
                hv = a * x[None, s : s + _CHUNK] + b  # wraps mod 2^64
                np.minimum(best, hv.min(axis=1), out=best)
        return best.view(np.int64)

    return one


def minhash_signature(hashes: Column, num_perm: int = DEFAULT_PERM) -> Column:
    """MinHash signature of a set given as an array of 64-bit shingle
    hashes (signed-long bits); empty set -> all zeros."""
    fn = _signature_fn(max(1, num_perm))

    @F.pandas_udf(ArrayType(LongType()))
    def _sig(col: pd.Series) -> pd.Series:
        return pd.Series([fn(v) for v in col])

    return _sig(hashes)


# Limbs of a hash ``x``, 16 bits each, lowest first.
LIMBS = ["x0", "x1", "x2", "x3"]
_LOW, _SIGN = (1 << 32) - 1, 1 << 31


def minhash_limbs(x: Column) -> list[Column]:
    return [F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")).alias(c) for i, c in enumerate(LIMBS)]


def minhash_terms(first: int, last: int, num_perm: int) -> list[Column]:
    """(a*x + b) mod 2^64 of permutations first to last, from the columns LIMBS,
    with the sign bit turned, so that signed order is unsigned order. With a in
    halves of 32 bits and x in limbs of 16, no product reaches 2^48."""
    x0, x1, x2, x3 = (F.col(c) for c in LIMBS)
    word = lambda v: F.lit(v).cast("long")
    out = []
    for a, b in list(zip(*minhash_params(num_perm), strict=True))[first:last]:
        al, ah = word(a & _LOW), word(a >> 32)
        p0, p1 = al * x0, al * x1
        low = p0.bitwiseAND(word(_LOW)) + F.shiftleft(p1.bitwiseAND(word(0xFFFF)), 16) + word(b & _LOW)
        top = F.shiftleft((al * x3 + ah * x1).bitwiseAND(word(0xFFFF)), 16)
        high = F.shiftright(p0, 32) + F.shiftright(p1, 16) + al * x2 + ah * x0 + top + word(b >> 32) + F.shiftright(low, 32)
        out.append(F.shiftleft(high.bitwiseAND(word(_LOW)) - word(_SIGN), 32).bitwiseOR(low.bitwiseAND(word(_LOW))))
    return out


def minhash_value(least: Column) -> Column:
    """The signature value of a least term (null, of an empty set: 0)."""
    return F.coalesce(least.bitwiseXOR(F.lit(-(1 << 63)).cast("long")), F.lit(0).cast("long"))


def minhash_similarity(a: Column, b: Column) -> Column:
    """Share of equal positions over the shorter signature."""
    n = F.least(F.size(a), F.size(b))
    eq = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when(n == 0, F.lit(0.0))
        .otherwise(eq / n)
    )


def simhash64(hashes_col: str) -> Column:
    """64-bit SimHash from the per-token hash array named ``hashes_col``
    (repeats kept). Bit i is set when more tokens have it set than not."""
    h = f"`{hashes_col}`"
    expr = (
        f"IF(size({h}) = 0, 0L, aggregate(sequence(0, 63), 0L, (acc, i) -> acc | "
        f"IF(2 * size(filter({h}, x -> (shiftright(x, i) & 1L) = 1L)) > size({h}), shiftleft(1L, i), 0L)))"
    )
    return F.expr(expr)


def simhash_similarity(a: Column, b: Column) -> Column:
    """E5: 1 - hamming/64."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def winnow_from_hex(hex_col: str, window: int = DEFAULT_WINDOW) -> Column:
    """Winnowing over the ordered shingle hashes (16-hex, repeats kept)
    in ``hex_col``: minimum of every full window of ``window`` hashes; a list
    no longer than the window gives its single minimum. Ties cannot change
    the set of values, so no position bookkeeping is needed."""
    w = max(1, int(window or 1))
    h = F.col(hex_col)
    n = F.size(h)
    mins = F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.array_min(F.slice(h, i, w)))
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n <= w, F.array(F.array_min(h)))
        .otherwise(F.array_distinct(mins))
    )


def shingle_hex(shingles: Column) -> Column:
    """Ordered 16-hex hashes of a shingle list (input of winnowing)."""
    return F.transform(shingles, lambda s: hash64_hex(s))


def jaccard(a: Column, b: Column) -> Column:
    """E1 on two array-sets: |A∩B| / (|A|+|B|-|A∩B|); both empty 1, one empty 0."""
    inter = F.size(F.array_intersect(a, b))
    na, nb = F.size(a), F.size(b)
    return (
        F.when((na == 0) & (nb == 0), F.lit(1.0))
        .when((na == 0) | (nb == 0), F.lit(0.0))
        .otherwise(inter / (na + nb - inter))
    )


# --- Arrow forms ------------------------------------------------------------
SLICE = 1 << 20  # tokens (or characters) worked on at a time


def row_slices(n: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) whose lengths ``n`` add up to ``most`` at most, or
    single rows."""
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _lengths(lists: pa.Array) -> np.ndarray:
    """Lengths of the rows of a list column; null rows have none."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _as_lists(parts: list[np.ndarray]) -> pa.Array:
    """One list of longs a row, from arrays of 64 bits."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: one to one on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sha64(data: list[bytes]) -> np.ndarray:
    """First 8 bytes of SHA-1 of each, as unsigned numbers."""
    return np.frombuffer(b"".join([hashlib.sha1(x).digest()[:8] for x in data]), ">u8").astype(np.uint64)


def _token_codes(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row lengths, place of each token among the distinct ones, hashes of the
    distinct ones)."""
    coded = lists.flatten().dictionary_encode()
    return _lengths(lists), coded.indices.to_numpy(zero_copy_only=False), _sha64([x.encode() for x in coded.dictionary.to_pylist()])


def _keys_of_row(h: np.ndarray, k: int) -> np.ndarray:
    size = max(1, min(k, len(h)))
    key = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size):
        key = mix64((key * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(h) - size + 1 + i])
    return np.unique(key)


def shingle_keys_of_tokens(tokens: Column, k: int) -> Column:
    """A 64-bit key of each distinct k-shingle (B8) of a token array, mixed from
    the hashes of its tokens and their number."""

    @F.arrow_udf(ArrayType(LongType()))
    def keys(lists: pa.Array) -> pa.Array:
        n, code, hashes = _token_codes(lists)
        out, ends = [], np.cumsum(n)
        with np.errstate(over="ignore"):
            for a, b in zip(ends - n, ends, strict=True):
                out.append(_keys_of_row(hashes[code[a:b]], k))
        return _as_lists(out)

    return keys(tokens)


# Classes of the tokenizer's characters (B5): digits, capitals, small letters.
_CLASS, _SMALL = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 1, 2, 3
_SMALL[65:91] += 32
_HELD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a word


def _token_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of each token (B5) of UTF-8 bytes that end in a zero. A
    token starts where the class changes, but not at a small letter behind a
    capital, and at the capital of a run of them that a small letter follows."""
    c = _CLASS[raw]
    before, after = np.concatenate([[0], c[:-1]]).astype(np.uint8), np.concatenate([c[1:], [0]]).astype(np.uint8)
    starts = ((c != before) & (c != 0) & ~((c == 3) & (before == 2))) | ((c == 2) & (before == 2) & (after == 3))
    edges = np.flatnonzero(starts | ((c == 0) & (before != 0)))
    first = starts[edges]
    return edges[first], np.diff(edges, append=len(raw))[first]


def _tokens_of_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of each token (B5, lower-cased) of UTF-8 text behind
    which 9 zero bytes stand."""
    raw = np.frombuffer(data, np.uint8)
    at, size = _token_spans(raw)
    return at, _token_hashes(raw, at, size)


def _token_hashes(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    words = np.ndarray((max(0, len(raw) - 7),), "<u8", buffer=_SMALL[raw], strides=(1,))
    # Up to 8 characters are one word, so their hash is one to one.
    h = mix64(words[at] & _HELD[np.minimum(size, 8)])
    left, done = np.flatnonzero(size > 8), 8
    while len(left):
        h[left] = mix64(h[left] * np.uint64(0x9E3779B97F4A7C15) ^ (words[at[left] + done] & _HELD[np.minimum(size[left] - done, 8)]))
        done += 8
        left = left[size[left] > done]
    return h


def shingle_keys_of_text(text: Column, k: int) -> Column:
    """A 64-bit key of each distinct k-shingle (B8) of a text's tokens, mixed
    from the hashes of its tokens and their number. Tokens are found by numpy on
    the bytes of many texts at once; the text is NFKC-normalised already."""

    @F.arrow_udf(ArrayType(LongType()))
    def keys(texts: pa.Array) -> pa.Array:
        rows = [(x or "").encode() for x in texts.to_pylist()]
        out: list[np.ndarray] = []
        with np.errstate(over="ignore"):
            for a, b in row_slices(np.array([len(x) + 1 for x in rows], np.int64), SLICE):
                at, h = _tokens_of_bytes(b"\0".join(rows[a:b]) + bytes(9))
                ends = np.searchsorted(at, np.cumsum([len(x) + 1 for x in rows[a:b]])).tolist()
                windows = np.full(max(0, len(h) - k + 1), k, np.uint64)
                for i in range(k):
                    windows = mix64((windows * np.uint64(0x9E3779B97F4A7C15)) ^ h[i : len(windows) + i])
                for c, d in zip([0, *ends], ends):
                    out.append(np.unique(windows[c : d - k + 1]) if d - c >= k else _keys_of_row(h[c:d], k))
        return _as_lists(out)

    return keys(text)


def simhash_of_tokens(tokens: Column) -> Column:
    """E4 of a token array: ``simhash64`` of its tokens' hashes."""

    @F.arrow_udf(LongType())
    def simhash(lists: pa.Array) -> pa.Array:
        n, code, hashes = _token_codes(lists)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
        ends, out = np.cumsum(n), np.zeros(len(n), np.uint64)
        for a, b in row_slices(n, SLICE >> 3):
            some = np.flatnonzero(n[a:b]) + a
            if len(some):
                first = int(ends[a] - n[a])
                ones = np.add.reduceat(bits[code[first : ends[b - 1]]], ends[some] - n[some] - first, axis=0)
                out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return pa.array(out.view(np.int64))

    return simhash(tokens)


def simhash_of_text(text: Column) -> Column:
    """E4 of a text's tokens, found by numpy on the bytes of many texts at once;
    the text is NFKC-normalised already. Each distinct token is hashed once."""

    @F.arrow_udf(LongType())
    def simhash(texts: pa.Array) -> pa.Array:
        rows, out = [(x or "").encode() for x in texts.to_pylist()], np.zeros(len(texts), np.uint64)
        for a, b in row_slices(np.array([len(x) + 1 for x in rows], np.int64), SLICE >> 1):
            raw = np.frombuffer(b"\0".join(rows[a:b]) + bytes(9), np.uint8)
            at, size = _token_spans(raw)
            with np.errstate(over="ignore"):
                _, first, code = np.unique(_token_hashes(raw, at, size), return_index=True, return_inverse=True)
            small = _SMALL[raw].tobytes()
            hashes = _sha64([small[c : c + d] for c, d in zip(at[first].tolist(), size[first].tolist(), strict=True)])
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            to = np.searchsorted(at, np.cumsum([len(x) + 1 for x in rows[a:b]]))
            n = np.diff(to, prepend=0)
            some = np.flatnonzero(n)
            if len(some):
                ones = np.add.reduceat(bits[code], (to - n)[some], axis=0, dtype=np.int32)
                out[some + a] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8")[:, 0]
        return pa.array(out.view(np.int64))

    return simhash(text)


def _shingle_hashes(lists: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per row the hashes (B9) of its shingles (B7), in order: each shingle is a
    slice of the tokens joined by spaces."""
    for row in lists:
        data = [x.encode() for x in row.as_py() or ()]
        size = max(1, min(k, len(data)))
        line, ends = b" ".join(data), np.cumsum([len(x) + 1 for x in data], dtype=np.int64) - 1
        starts = np.concatenate([[0], ends + 1])[: max(0, len(data) - size + 1)]
        yield _sha64([line[a:b] for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)])


def minhash_of_tokens(tokens: Column, k: int, num_perm: int = DEFAULT_PERM) -> Column:
    """E2 of the shingle set of a token array."""
    fn = _signature_fn(max(1, num_perm))

    @F.arrow_udf(ArrayType(LongType()))
    def signature(lists: pa.Array) -> pa.Array:
        return _as_lists([fn(np.unique(h).view(np.int64)) for h in _shingle_hashes(lists, k)])

    return signature(tokens)


def winnow_of_tokens(tokens: Column, k: int, window: int = DEFAULT_WINDOW) -> Column:
    """E6 of the shingles of a token array, as longs."""
    w = max(1, int(window or 1))

    @F.arrow_udf(ArrayType(LongType()))
    def winnow(lists: pa.Array) -> pa.Array:
        out = []
        for h in _shingle_hashes(lists, k):
            size = min(w, len(h))
            least = h[: len(h) - size + 1].copy()
            for i in range(1, size):
                np.minimum(least, h[i : len(h) - size + 1 + i], out=least)
            out.append(np.unique(least if size else h))
        return _as_lists(out)

    return winnow(tokens)


def _packed_grams(stream: bytes, n: int) -> np.ndarray:
    """The distinct n-grams (n <= 8) of ASCII characters, first one highest; a
    shorter stream is one gram."""
    size = min(n, len(stream))
    chars = np.frombuffer(stream, np.uint8).astype(np.uint64)
    gram = np.zeros(len(stream) - size + 1 if size else 0, np.uint64)
    for i in range(size):
        gram = (gram << np.uint64(8)) | chars[i : len(stream) - size + 1 + i]
    return np.unique(gram)


def stream_of_text(text: Column) -> Column:
    """B10 of a text that is NFKC-normalised already: its tokens, joined by
    single spaces, found by numpy on the bytes of many texts at once."""

    @F.arrow_udf("string")
    def stream(texts: pa.Array) -> pa.Array:
        rows, out = [(x or "").encode() for x in texts.to_pylist()], []
        for a, b in row_slices(np.array([len(x) + 1 for x in rows], np.int64), SLICE):
            raw = np.frombuffer(b"\0".join(rows[a:b]) + bytes(1), np.uint8)
            at, size = _token_spans(raw)
            # Every token with one byte behind it, which is its space.
            ends = np.cumsum(size + 1)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size + 1, size + 1)
            joined = _SMALL[raw[place]]
            joined[ends - 1] = 32
            line = joined.tobytes().decode("ascii")
            to = np.concatenate([[0], ends])[np.searchsorted(at, np.cumsum([len(x) + 1 for x in rows[a:b]]))]
            out += [line[c : max(c, d - 1)] for c, d in zip([0, *to[:-1].tolist()], to.tolist(), strict=True)]
        return pa.array(out, pa.string())

    return stream(text)


def grams_of_streams(streams: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends of the rows, distinct n-grams of each row) of token streams, as
    numbers: up to 8 characters are their own, longer ones hash."""
    out = []
    for s in streams.to_pylist():
        s = (s or "").encode()
        out.append(_packed_grams(s, n) if n <= 8 else np.unique(_sha64([s[i : i + n] for i in range(max(1, len(s) - n + 1))] if s else [])))
    return np.cumsum([0, *map(len, out)]), np.concatenate([np.empty(0, np.uint64), *out])


def gram_jaccard(a: Column, b: Column, n: int) -> Column:
    """E1 of the distinct character n-grams (B11) of two token streams: the sets
    are made where they are compared."""

    @F.arrow_udf("double")
    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for some in range(0, len(left), 256):
            sides = [grams_of_streams(x.slice(some, 256), n) for x in (left, right)]
            for (la, lb), (ra, rb) in zip(*(zip(ends, ends[1:]) for ends, _ in sides), strict=True):
                inter = len(np.intersect1d(sides[0][1][la:lb], sides[1][1][ra:rb], assume_unique=True))
                both = int(lb - la + rb - ra) - inter
                out.append(inter / both if both else 1.0)
        return pa.array(out, pa.float64())

    return score(a, b)


def gram_keys(stream: Column, n: int) -> Column:
    """A 64-bit key of each distinct character n-gram (B11) of a token stream,
    which is ASCII: up to 8 characters are their own key, longer ones hash."""

    @F.arrow_udf(ArrayType(LongType()))
    def keys(streams: pa.Array) -> pa.Array:
        out = []
        for text in streams:
            s = (text.as_py() or "").encode()
            out.append(_packed_grams(s, n) if n <= 8 else np.unique(_sha64([s[i : i + n] for i in range(max(1, len(s) - n + 1))] if s else [])))
        with np.errstate(over="ignore"):
            return _as_lists([mix64(x) for x in out])

    return keys(stream)


def gram_strings(stream: Column, n: int) -> Column:
    """The distinct character n-grams (B11, n <= 8) of a token stream, in order
    of their bytes."""

    @F.arrow_udf("array<string>")
    def grams(streams: pa.Array) -> pa.Array:
        data, sizes, counts = [], [], []
        for text in streams:
            s = (text.as_py() or "").encode()
            size, found = min(n, len(s)), _packed_grams(s, n)
            data.append(found.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - size :].tobytes())
            sizes.append(np.full(len(found), size))
            counts.append(len(found))
        ends = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int64).astype(np.int32)
        values = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(b"".join(data)))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), values)

    return grams(stream)
