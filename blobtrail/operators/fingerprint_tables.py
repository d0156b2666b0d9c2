"""Per-row fingerprints of a text column for each similarity mode, as the
inputs of the pair joins: item sets (array<long>), MinHash signatures or
SimHash values. Row-local; no shuffle. The joins read them several times, so
they are written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blobtrail.functions import fingerprints as fp
from blobtrail.functions import tokens as tk
from blobtrail.session import written

MINIMA = 32  # minima of one aggregation, so that its code stays compiled
MODES = ("jaccard", "charjaccard", "minhash", "simhash", "winnow")


def with_minhash(df: DataFrame, hashes_col: str, out: str, num_perm: int = fp.DEFAULT_PERM) -> DataFrame:
    """Adds ``out``: the E2 signature of the hashes in ``hashes_col``, as
    minima over exploded hashes. A row's hashes lie in one task, so the partial
    aggregation leaves one row each before anything is shuffled."""
    num_perm = max(1, int(num_perm))
    rows = written(df.withColumn("_rid", F.monotonically_increasing_id()))  # ids are fixed from here on
    limbs = rows.select("_rid", F.explode(hashes_col).alias("x")).select("_rid", *fp.minhash_limbs(F.col("x")))
    names = [f"_m{i}" for i in range(num_perm)]
    for first in range(0, num_perm, MINIMA):
        last = min(num_perm, first + MINIMA)
        least = [F.min(term).alias(name) for term, name in zip(fp.minhash_terms(first, last, num_perm), names[first:last], strict=True)]
        rows = rows.join(limbs.groupBy("_rid").agg(*least), "_rid", "left")
    return rows.withColumn(out, F.array(*[fp.minhash_value(F.col(n)) for n in names])).drop("_rid", *names)


def with_stream(df: DataFrame, text_col: str, out: str = "fp") -> DataFrame:
    """Adds ``out``: the token stream (B10) of a text, from which the sets of
    charjaccard are made where they are compared: as 64-bit keys its n-grams
    take several times the text's room."""
    return written(df.withColumn(out, fp.stream_of_text(tk.nfkc(F.col(text_col)))).drop(text_col))


def with_fingerprint(
    df: DataFrame,
    text_col: str,
    mode: str,
    k: int = tk.DEFAULT_K,
    n: int = tk.DEFAULT_N,
    window: int = tk.DEFAULT_WINDOW,
    num_perm: int = fp.DEFAULT_PERM,
    out: str = "fp",
) -> DataFrame:
    """Adds ``out``: items array<long> for jaccard/charjaccard/winnow, the
    MinHash signature array<long>, or the SimHash long. Item keys are 64-bit
    hashes of the shingles / n-grams (a collision would merge two items;
    probability about m^2 / 2^65 for m distinct items)."""
    if mode not in MODES:
        raise ValueError(f"unknown similarity mode {mode!r}; expected one of {MODES}")
    k = max(1, int(k))
    if mode == "jaccard":
        return written(df.withColumn(out, fp.shingle_keys_of_text(tk.nfkc(F.col(text_col)), k)).drop(text_col))
    if mode == "simhash":
        return written(df.withColumn(out, fp.simhash_of_text(tk.nfkc(F.col(text_col)))).drop(text_col))
    tmp = tk.with_array(df, "_tok", tk.tokenize(F.col(text_col)))
    if mode == "charjaccard":
        res = tmp.withColumn(out, fp.gram_keys(tk.token_stream(F.col("_tok")), max(1, int(n))))
    elif mode == "winnow":
        res = tmp.withColumn(out, fp.winnow_of_tokens(F.col("_tok"), k, window))
    else:  # minhash
        res = tmp.withColumn(out, fp.minhash_of_tokens(F.col("_tok"), k, max(1, int(num_perm))))
    return written(res.drop("_tok", text_col))
