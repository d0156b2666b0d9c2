"""Similarity joins without comparing all pairs, and without losing any
pair at or above the threshold.

* set modes (jaccard, charjaccard, winnow): prefix, length and positional
  filters (Chaudhuri et al. 2006; Xiao et al. 2008): items have a total order,
  rare ones first, each set keeps its first ``n - ceil(t*n) + 1`` items, and
  only sets sharing one of these become candidates; candidates are verified
  exactly. Any total order loses no pair, so the order comes from a sketch of
  fixed size, the counts of ``1 << SKETCH_BITS`` buckets of items: never below
  an item's own count, so a frequent item never passes for a rare one. The
  sketch is broadcast, prefixes are cut inside each row, and nothing but
  prefix items is exploded or shuffled, with 64-bit ids for keys and blocks.
  The sketch counts the right side, which bounds what a left prefix item meets.
  Candidates are verified in cells (``tiles``): a set is moved once for all its
  pairs in a cell, not once a pair.
* set modes over few items (charjaccard, whose n-grams come from a small
  alphabet, so that even the rarest are common): sketches compared in tiles
  (``by="sketch"``, see ``tiles``): no pair is written but those that pass.
* the same by ``by="parts"``: the partition scheme
  (Arasu et al. 2006; Deng et al. 2015). Sets of a size up to M and Jaccard >= t
  differ in at most D = ``floor(2M(1-t)/(1+t))`` items, so of D + 1 parts of the
  items some are equal, and only sets with equal parts meet. M is the largest
  size of a size group; a set is dealt into parts for its own group and for the
  groups of the larger sets that it may match. A pair stays a candidate while
  its unequal parts are no more than the items in which it may differ.
* minhash: at most ``P - ceil(t*P)`` positions may differ, so that many
  bands plus one guarantee an equal band.
* simhash: multi-index search (Norouzi et al. 2012). The 64 bits are dealt to
  few wide blocks, each with a share of the distance d = ``floor(64*(1-t))``; the
  shares plus one add up to d + 1, so some block lies within its share. Both
  sides list their block's neighbours, each up to its part of the share, and
  meet at the one between; the whole distance is checked in the join itself,
  and of all meetings of a pair only one counts (its first block within its
  share, the left side turning the lowest bit that differs), so the join
  gives each pair of the result once and nothing else.

Inputs are "signature tables": one row per distinct set (copies of the same
content are collapsed by the caller), so a group of identical files costs
one row, not a quadratic number of pairs. An optional ``block`` column
restricts pairs to equal blocks (e.g. same base name)."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtrail.functions.fingerprints import mix64, minhash_similarity, row_slices, simhash_similarity

EPS = 1e-9
SKETCH_BITS = 20
# An empty set is replaced by this single item: J({s},{s}) = 1 and
# J({s}, X) = 0 for any non-empty X, exactly the reference's rules for empty
# sets, while keeping empty sets inside the equi-join.
EMPTY_ITEM = -0x6A09E667F3BCC909


def checked_threshold(threshold: float) -> float:
    """Every pair scores 0 or more, so a threshold of 0 asks for all pairs:
    refused, like one that nothing reaches."""
    t = float(threshold)
    if not 0 < t <= 1:
        raise ValueError(f"similarity threshold must be above 0 and at most 1, not {threshold!r}")
    return t


def _with_block(df: DataFrame, block: str | None) -> tuple[DataFrame, list[str]]:
    if block is None:
        return df.withColumn("_blk", F.lit(0)), ["_blk"]
    return df.withColumnRenamed(block, "_blk"), ["_blk"]


def _buckets(items: np.ndarray) -> np.ndarray:
    x, bits = items.view(np.uint64), np.uint64(SKETCH_BITS)
    return ((x ^ (x >> bits) ^ (x >> (bits + bits))) & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _item_sketch(sets: DataFrame):
    """Counts of the items by bucket, broadcast: ``1 << SKETCH_BITS`` numbers,
    whatever the input. Each task counts its items; only counts are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            lists = batch.column("items")
            for a, b in row_slices(lists.value_lengths().to_numpy(zero_copy_only=False)):
                f += np.bincount(_buckets(lists.slice(a, b - a).flatten().to_numpy()), minlength=len(f))
        some = np.flatnonzero(f)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(f[some])], ["b", "f"])

    counted = sets.select("items").mapInArrow(count, "b int, f long").groupBy("b").agg(F.sum("f").alias("f"))
    found = counted.toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[found.column("b").to_numpy()] = found.column("f").to_numpy()
    return sets.sparkSession.sparkContext.broadcast(sketch)


def _prefixes(sets: DataFrame, sketch, t: float) -> DataFrame:
    """(id, n, item, rn): the first items of each set (k, _blk, items, n) in the
    order (sketch count, item), up to the prefix length. Items of different
    blocks differ."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            lengths = pc.list_value_length(batch.column("items")).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in row_slices(lengths):  # so that memory doesn't grow with the sets of a batch
                part, n = batch.slice(a, b - a), lengths[a:b]
                items = part.column("items").flatten().to_numpy()
                common, ends, kept = counts[_buckets(items)], np.cumsum(n), []
                most = n - np.ceil(n * t - EPS).astype(np.int64) + 1
                for i, end in enumerate(ends.tolist()):
                    c = common[end - n[i] : end]
                    # Only items no more common than the last of the prefix are sorted.
                    some = np.flatnonzero(c <= np.partition(c, most[i] - 1)[most[i] - 1]) if len(c) else np.empty(0, np.int64)
                    kept.append(some[np.lexsort((items[some + end - n[i]], c[some]))[: most[i]]] + end - n[i])
                size = np.array([len(x) for x in kept], np.int64)
                at, rank = pa.array(np.repeat(np.arange(len(n)), size)), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
                cols = [part.column("id").take(at), part.column("_h").take(at), part.column("n").take(at), pa.array(items[np.concatenate(kept)]), pa.array(rank.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "_h", "n", "item", "rn"])

    rows = _named(sets).select("id", F.xxhash64("_blk").alias("_h"), "items", "n").mapInArrow(over, "id long, _h long, n int, item long, rn int")
    return rows.select("id", "n", F.xxhash64("_h", "item").alias("item"), "rn") if dict(sets.dtypes)["_blk"] != "int" else rows.drop("_h")


def size_groups(most: int, t: float) -> list[int]:
    """Smallest size of each size group, up to the one behind ``most``; two groups
    reach 1/t times as far as the first begins."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] / math.sqrt(t) - EPS)))
    return edges


def may_differ(total: int | np.ndarray, t: float):
    """In how many items sets of ``total`` items together differ at most."""
    return np.floor(total * ((1 - t) / (1 + t)) + EPS).astype(np.int64)


def _part_keys(items: np.ndarray, group: int, m: int) -> np.ndarray:
    """One key for each of the ``m`` parts that a set is dealt into."""
    mixed = mix64(items.view(np.uint64))
    sums = np.zeros(m, np.uint64)
    np.add.at(sums, (mixed % np.uint64(m)).astype(np.int64), mix64(mixed + np.uint64(1)))
    return mix64(sums ^ mix64(np.arange(m, dtype=np.uint64) + np.uint64(group + 1 << 32)))


def _parts(sets: DataFrame, t: float) -> DataFrame:
    """(part, id, n, m, own): the parts of each set (id, _blk, items, n) in its
    own size group and those of larger sets that it may match, of ``m`` parts
    each. Sets of different blocks have no part in common."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [1]
        for batch in batches:
            lists, ids, blocks, sizes = (batch.column(c) for c in ("items", "id", "_blk", "n"))
            n = sizes.to_numpy().astype(np.int64)
            edges = edges if len(n) == 0 or edges[-1] > n.max() / t + 1 else size_groups(math.floor(n.max() / t) + 1, t)
            for a, b in row_slices(n):
                keys, rows, ms, owns = [], [], [], []
                items, ends = lists.slice(a, b - a).flatten().to_numpy(), np.cumsum(n[a:b])
                with np.errstate(over="ignore"):
                    for i, end in enumerate(ends.tolist()):
                        size = int(n[a + i])
                        g = bisect_right(edges, size) - 1
                        for group in range(g, bisect_right(edges, math.floor(size / t + EPS))):
                            m = int(may_differ(2 * (edges[group + 1] - 1), t)) + 1
                            keys.append(_part_keys(items[end - size : end], group, m))
                            rows.append(a + i)
                            ms.append(m)
                            owns.append(group == g)
                each = np.array(ms)
                at = pa.array(np.repeat(np.array(rows), each))
                cols = [pa.array(np.concatenate(keys).view(np.int64)), ids.take(at), blocks.take(at), sizes.take(at), pa.array(np.repeat(each, each).astype(np.int32)), pa.array(np.repeat(np.array(owns), each))]
                yield pa.RecordBatch.from_arrays(cols, ["part", "id", "_blk", "n", "m", "own"])

    kind = {f.name: f.dataType.simpleString() for f in sets.schema.fields}
    rows = sets.select("id", "_blk", "items", "n").mapInArrow(over, f"part long, id long, _blk {kind['_blk']}, n int, m int, own boolean")
    return rows.select(F.xxhash64("_blk", "part").alias("part"), "id", "n", "m", "own")


def _named(df: DataFrame) -> DataFrame:
    """Adds a 64-bit id for the key and block."""
    whole = dict(df.dtypes)["k"] == "bigint" and dict(df.dtypes)["_blk"] == "int"  # no block
    return df.withColumn("id", F.col("k") if whole else F.xxhash64("k", "_blk"))


def _whole_sets(cand: DataFrame, left: DataFrame, right: DataFrame, t: float, self_join: bool, skip_equal_keys: bool, made: Callable | None = None) -> DataFrame:
    """The candidates (l_id, r_id) that reach the threshold, from their whole
    sets; those of a self-join with the smaller key first."""
    from blobtrail.operators.tiles import common_items, in_cells

    enough = lambda l_n, r_n, inter: inter / np.maximum(l_n + r_n - inter, 1) >= t
    joined = in_cells(cand, left, right, self_join, common_items, enough, made)
    scored = joined.select("l_key", "r_key", "_blk", "l_n", "r_n", "inter", (F.col("inter") / (F.col("l_n") + F.col("r_n") - F.col("inter"))).alias("score"))
    if self_join:
        order = [F.least("l_key", "r_key").alias("l_key"), F.greatest("l_key", "r_key").alias("r_key"), "_blk", "inter"]
        turned = F.col("l_key") > F.col("r_key")
        sizes = [F.when(turned, F.col("r_n")).otherwise(F.col("l_n")).alias("l_n"), F.when(turned, F.col("l_n")).otherwise(F.col("r_n")).alias("r_n")]
        return scored.where("l_key <> r_key").select(*order[:3], *sizes, "inter", "score")
    return scored.where("l_key <> r_key") if skip_equal_keys else scored


def _pairs_by_parts(left: DataFrame, right: DataFrame, t: float, self_join: bool, skip_equal_keys: bool) -> DataFrame:
    """``set_pairs`` by the partition scheme. Rows carry a 64-bit id for the key
    and block; what a collision brings together, the whole sets tell apart."""
    L = _named(left)
    R = L if self_join else _named(right)
    lp = _parts(L, t)
    a, b = lp.alias("a"), (lp if self_join else _parts(R, t)).alias("b")
    # The larger set's own group, where both have as many parts.
    cond = (F.col("a.part") == F.col("b.part")) & (F.col("a.m") == F.col("b.m")) & (F.col("a.own") | F.col("b.own"))
    cond = cond & (F.col("b.n") >= F.ceil(F.col("a.n") * t - EPS)) & (F.col("b.n") * t <= F.col("a.n") + EPS)
    if self_join:
        cond = cond & (F.col("a.id") < F.col("b.id"))
    met = a.join(b, cond).groupBy(F.col("a.id").alias("l_id"), F.col("b.id").alias("r_id"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.m").alias("m"))
    most = F.floor((F.col("na") + F.col("nb")) * F.lit((1 - t) / (1 + t)) + EPS)
    cand = met.agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= F.col("m") - most).select("l_id", "r_id").distinct()
    return _whole_sets(cand, L, R, t, self_join, skip_equal_keys)


def set_pairs(
    left: DataFrame,
    right: DataFrame | None,
    threshold: float,
    key: str = "key",
    items: str = "items",
    block: str | None = None,
    skip_equal_keys: bool = False,
    by: str = "prefix",
    grams: int | None = None,
) -> DataFrame:
    """Exact set-similarity join, by prefixes, by parts (``by="parts"``) or by
    sketches in tiles (``by="sketch"``).

    ``left``/``right``: (key, [block], items array<long> of distinct items), or,
    with ``grams``, token streams whose n-grams of that size are the items; such
    sets are made where they are compared (by sketches alone).
    ``right=None`` is a self-join returning each unordered pair once
    (l_key < r_key). Returns (l_key, r_key, [block], inter, l_n, r_n, score)
    for every pair with Jaccard >= threshold."""
    t = checked_threshold(threshold)
    self_join = right is None

    def prep(df: DataFrame) -> DataFrame:
        df, _ = _with_block(df, block)
        if grams:
            return df.select(F.col(key).alias("k"), "_blk", F.col(items).alias("items")).withColumn("n", F.length("items"))
        s = F.when(F.size(items) == 0, F.array(F.lit(EMPTY_ITEM))).otherwise(F.col(items))
        return df.select(F.col(key).alias("k"), "_blk", s.alias("items")).withColumn("n", F.size("items"))

    L = prep(left)
    R = L if self_join else prep(right)
    if grams and by != "sketch":
        raise ValueError("n-grams of streams are joined by sketches")
    if by == "parts":
        return _restore_block(_pairs_by_parts(L, R, t, self_join, skip_equal_keys), block)
    if by == "sketch":
        from blobtrail.operators.tiles import gram_sets, sketch_candidates

        L, R, given = _named(L), _named(R), {"made": gram_sets(grams)} if grams else {}
        return _restore_block(_whole_sets(sketch_candidates(L, R, t, self_join, **given), L, R, t, self_join, skip_equal_keys, **given), block)
    sketch = _item_sketch(R.select("items"))
    # Rows carry 64-bit ids, not keys and blocks; what a collision brings
    # together, the whole sets tell apart.
    lp = _prefixes(L, sketch, t)
    rp = lp if self_join else _prefixes(R, sketch, t)
    a, b = lp.alias("a"), rp.alias("b")
    cond = F.col("a.item") == F.col("b.item")
    # length filter: t*nA <= nB <= nA/t
    cond = cond & (F.col("b.n") >= F.ceil(F.col("a.n") * t - EPS)) & (F.col("b.n") * t <= F.col("a.n") + EPS)
    if self_join:
        cond = cond & (F.col("a.id") < F.col("b.id"))
    elif skip_equal_keys:
        cond = cond & (F.col("a.id") != F.col("b.id"))
    still = 1 + F.least(F.col("a.n") - F.col("a.rn"), F.col("b.n") - F.col("b.rn"))
    met = a.join(b, cond).groupBy(F.col("a.id").alias("l_id"), F.col("b.id").alias("r_id"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(
        F.count(F.lit(1)).alias("c"), F.max("a.rn").alias("ia"), F.max("b.rn").alias("ib"), F.max(still).alias("most")
    )
    # positional filter: a pair shares at its first common prefix item no more
    # than ``most``; in all, the common prefix items and what either set has
    # behind the last of them, or behind its whole prefix.
    suffix = lambda n: F.ceil(n * F.lit(t) - F.lit(EPS)) - 1
    behind = F.least(F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")), F.greatest(suffix(F.col("na")), suffix(F.col("nb"))))
    need = F.ceil((F.col("na") + F.col("nb")) * (t / (1 + t)) - EPS)
    cand = met.where((F.col("most") >= need) & (F.col("c") + behind >= need)).select("l_id", "r_id").distinct()
    return _restore_block(_whole_sets(cand, _named(L), _named(R), t, self_join, skip_equal_keys), block)


def _restore_block(df: DataFrame, block: str | None) -> DataFrame:
    if block is None:
        return df.drop("_blk")
    return df.withColumnRenamed("_blk", block)


def _bands(total: int, parts: int) -> list[tuple[int, int]]:
    """Split positions [0,total) into ``parts`` contiguous (start, length)."""
    parts = max(1, min(parts, total))
    base, extra = divmod(total, parts)
    out, start = [], 0
    for i in range(parts):
        ln = base + (1 if i < extra else 0)
        out.append((start, ln))
        start += ln
    return out


def minhash_pairs(
    left: DataFrame,
    right: DataFrame | None,
    threshold: float,
    num_perm: int,
    key: str = "key",
    sig: str = "sig",
    block: str | None = None,
    skip_equal_keys: bool = False,
) -> DataFrame:
    """Exact MinHash-estimate join: (l_key, r_key, [block], score) with
    score >= threshold, via lossless banding."""
    t = checked_threshold(threshold)
    self_join = right is None
    max_diff = num_perm - math.ceil(t * num_perm - EPS)
    bands = _bands(num_perm, max_diff + 1)

    def prep(df: DataFrame) -> DataFrame:
        df, _ = _with_block(df, block)
        return df.select(F.col(key).alias("k"), "_blk", F.col(sig).alias("sig"))

    L = prep(left)
    R = L if self_join else prep(right)

    def band_keys(df: DataFrame) -> DataFrame:
        keys = F.array(*[
            F.struct(F.lit(i).alias("band"), F.xxhash64(F.slice("sig", s + 1, ln)).alias("bh"))
            for i, (s, ln) in enumerate(bands)
        ])
        return df.select("k", "_blk", F.explode(keys).alias("b")).select("k", "_blk", "b.band", "b.bh")

    lb = band_keys(L)
    rb = lb if self_join else band_keys(R)
    a, b = lb.alias("a"), rb.alias("b")
    cond = (F.col("a.bh") == F.col("b.bh")) & (F.col("a.band") == F.col("b.band")) & (F.col("a._blk") == F.col("b._blk"))
    if self_join:
        cond = cond & (F.col("a.k") < F.col("b.k"))
    elif skip_equal_keys:
        cond = cond & (F.col("a.k") != F.col("b.k"))
    cand = a.join(b, cond).select(F.col("a.k").alias("l_key"), F.col("b.k").alias("r_key"), F.col("a._blk").alias("_blk")).distinct()
    lv = L.select(F.col("k").alias("l_key"), "_blk", F.col("sig").alias("l_sig"))
    rv = R.select(F.col("k").alias("r_key"), "_blk", F.col("sig").alias("r_sig"))
    scored = (
        cand.join(lv, ["l_key", "_blk"]).join(rv, ["r_key", "_blk"])
        .withColumn("score", minhash_similarity(F.col("l_sig"), F.col("r_sig")))
        .where(F.col("score") >= F.lit(t))
        .drop("l_sig", "r_sig")
    )
    return _restore_block(scored, block)


MOST_SHARE = 3


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >= 1 << 63 else bits


def simhash_reach(threshold: float) -> int:
    """The largest distance whose score reaches the threshold."""
    t = checked_threshold(threshold)
    return max(d for d in range(64) if d <= max(0, math.floor(64 * (1 - t) + EPS)) and (d == 0 or 1 - d / 64 >= t))


def simhash_ranks(df: DataFrame, threshold: float, key: str = "key", fp: str = "fp") -> DataFrame:
    """F1 over the SimHash self-join: (doc, other, score, rank), each pair in both
    directions, ranked as ``ordered_rank`` does by score and the other's key.
    Ranks are made where the pairs are found (``tiles``)."""
    from blobtrail.operators.tiles import ranked_simhashes

    return ranked_simhashes(df.select(F.col(key).alias("k"), F.col(fp).alias("fp")), simhash_reach(threshold))


def simhash_blocks(max_dist: int) -> list[tuple[int, int]]:
    """(mask, share of the distance) of each block: as few blocks as keep every
    share at ``MOST_SHARE`` or less and leave two at least, the bits dealt out
    in turn."""
    m = min(64, max(1 if max_dist == 0 else 2, -(-(max_dist + 1) // (MOST_SHARE + 1))))
    base, extra = divmod(max_dist + 1, m)
    return [(sum(1 << bit for bit in range(i, 64, m)), base + (i < extra) - 1) for i in range(m)]


def _neighbours(mask: int, reach: int) -> list[tuple[int, int]]:
    """(bits to turn, all bits below the lowest of them; all bits for none)."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    out = [(0, (1 << 64) - 1)]
    for n in range(1, reach + 1):
        out += [(sum(some), some[0] - 1) for some in combinations(bits, n)]
    return out


def simhash_pairs(
    left: DataFrame,
    right: DataFrame | None,
    threshold: float,
    key: str = "key",
    fp: str = "fp",
    block: str | None = None,
    skip_equal_keys: bool = False,
    by: str = "index",
) -> DataFrame:
    """Exact SimHash join: (l_key, r_key, [block], score) with
    1 - hamming/64 >= threshold, by multi-index search. A self-join without
    blocks, whose pairs are a share of all, also ``by="tiles"``."""
    t = checked_threshold(threshold)
    if by == "tiles":
        from blobtrail.operators.tiles import near_simhashes

        if right is not None or block is not None:
            raise ValueError("tiles are for a self-join without blocks")
        return near_simhashes(left.select(F.col(key).alias("k"), F.col(fp).alias("fp")), simhash_reach(t))
    self_join, key_col = right is None, key
    max_dist = max(0, math.floor(64 * (1 - t) + EPS))
    blocks = simhash_blocks(max_dist)

    def prep(df: DataFrame, reach: Callable[[int], int]) -> DataFrame:
        df, _ = _with_block(df, block)
        turns = F.array(*[
            F.struct(*[F.lit(_signed(v)).cast("long").alias(c) for c, v in (("i", i), ("mask", mask), ("turn", f), ("low", low))])
            for i, (mask, share) in enumerate(blocks) for f, low in _neighbours(mask, reach(share))
        ])
        near = F.col("fp").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.turn"))
        each = df.select(F.col(key_col).alias("k"), "_blk", F.col(fp).alias("fp"), F.explode(turns).alias("x"))
        return each.select("k", "_blk", "fp", F.col("x.i").alias("i"), near.alias("near"), "x.mask", "x.turn", "x.low")

    a = prep(left, lambda share: min(1, share)).alias("a")
    b = prep(left if self_join else right, lambda share: max(0, share - 1)).select("k", "_blk", "fp", "i", "near").alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    inside = differ.bitwiseAND(F.col("a.mask"))
    beyond = [F.bit_count(differ.bitwiseAND(F.lit(_signed(mask)))) > share for mask, share in blocks]
    first = F.lit(True)
    for i in range(1, len(blocks)):
        first = first & ((F.col("a.i") < i) | beyond[i - 1])
    lowest = (inside.bitwiseAND(F.col("a.low")) == 0) & ((F.col("a.turn") == 0) | (inside.bitwiseAND(F.col("a.turn")) != 0))
    # The key with many values comes first: it is what sorts go by.
    cond = (F.col("a.near") == F.col("b.near")) & (F.col("a.i") == F.col("b.i")) & (F.col("a._blk") == F.col("b._blk"))
    cond = cond & (F.bit_count(differ) <= max_dist) & lowest & first
    if self_join:
        cond = cond & (F.col("a.k") < F.col("b.k"))
    elif skip_equal_keys:
        cond = cond & (F.col("a.k") != F.col("b.k"))
    # Sorted, as the size of the listed neighbours is far above Spark's estimate,
    # which would broadcast them.
    met = a.join(b.hint("merge"), cond)
    scored = met.select(
        F.col("a.k").alias("l_key"), F.col("b.k").alias("r_key"), F.col("a._blk").alias("_blk"), simhash_similarity(F.col("a.fp"), F.col("b.fp")).alias("score")
    ).where(F.col("score") >= F.lit(t))
    return _restore_block(scored, block)

