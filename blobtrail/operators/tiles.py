"""Work on all pairs of a block in tiles: rows of both sides are dealt into
tiles of bounded size, every pair of a left and a right tile of a block is one
group, and numpy compares its rows. What leaves a tile is what the caller
keeps of it (candidates, counts, best ones), so neither disk nor a task's
memory grows with the number of pairs.

``sketch_candidates``: candidates of a set join. A set's sketch has one bit a
bucket, turned once for every item in it. Sets that differ in s items have
sketches that differ in s bits at most, so no pair is lost; a sketch has
``BITS_PER_ITEM`` bits for each item in which a pair may differ, so others
hardly pass. Sets meet by size groups, as only sizes within the threshold do.

``in_cells``: pairs that are known already, checked against whole rows. Pairs
whose sides have the same neighbours share a cell, and a row goes to a cell
once, however many pairs it is in there.

``nearest_two``: per SimHash of the left side the number of right rows within
a distance and the two that come first, without listing the others.

``near_simhashes``, ``ranked_simhashes``: the pairs of SimHashes within a
distance, and each row's near ones with their ranks. These are a share of all
pairs, so nothing of them is shuffled or written: the rows are packed into
blocks, sorted by key, and tasks read pairs of blocks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blobtrail.functions.fingerprints import grams_of_streams, mix64, row_slices
from blobtrail.operators.pairs import EMPTY_ITEM, EPS, may_differ, size_groups
from blobtrail.session import written

LEFT_ROWS, RIGHT_ROWS = 1 << 15, 1 << 16  # of a tile
TILE_WORDS = 1 << 22  # 64-bit words of a tile's sketches
CELL_WORDS = 1 << 20  # 64-bit words of each side of a cell
BITS_PER_ITEM = 6
SOME_WORDS = 4  # of a sketch, after which those too far are left out
RANK_BITS, DIST_BITS = 24, 7  # of a tile's rows; of a distance of 64
BLOCK_ROWS = 1 << 11  # of a block of SimHashes
STEP_CELLS = 1 << 18  # distances worked out at a time
GIVEN_ROWS = 1 << 16  # of a batch of pairs, about


def by_tiles(left: DataFrame, right: DataFrame, block: list[str], fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str, words: Column | None = None) -> DataFrame:
    """``fn(left tile, right tile)`` for every pair of tiles with equal
    ``block`` columns. Rows are dealt by their column ``deal``; ``words`` is
    the size of a row of the block, where it isn't small."""
    rows = lambda most: F.lit(most) if words is None else F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(TILE_WORDS) / words)))
    count = lambda df, n: df.groupBy(*block).agg(F.count(F.lit(1)).alias(n))
    tiles = lambda n, most: F.ceil(F.col(n) / rows(most)).cast("long")
    dealt = written(count(left, "_n").join(count(right, "_m"), block).select(*block, tiles("_n", LEFT_ROWS).alias("_ls"), tiles("_m", RIGHT_ROWS).alias("_rs")))
    own = lambda n: F.pmod(F.xxhash64("deal"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = [*block, "_l", "_r"]
    ls = left.join(dealt, block).select(*left.columns, own("_ls").alias("_l"), "_rs").select("*", each("_rs").alias("_r")).drop("_rs")
    rs = right.join(dealt, block).select(*right.columns, own("_rs").alias("_r"), "_ls").select("*", each("_ls").alias("_l")).drop("_ls")
    return ls.groupBy(*keys).cogroup(rs.groupBy(*keys)).applyInArrow(fn, schema)


def _sketch_words(edges: list[int], group: int, t: float) -> int:
    bits = BITS_PER_ITEM * int(may_differ(2 * (edges[group + 1] - 1), t))
    return 1 << max(0, (bits - 1) // 64).bit_length()


def _listed(items: pa.Array) -> pa.Array:
    return items


def gram_sets(n: int) -> Callable[[pa.Array], pa.Array]:
    """Makes the sets of n-grams of token streams."""

    def sets(streams: pa.Array) -> pa.Array:
        ends, grams = grams_of_streams(streams, n)
        empty = ends[:-1][np.diff(ends) == 0]
        held = np.insert(grams.view(np.int64), empty, EMPTY_ITEM)
        ends = ends + np.concatenate([[0], np.cumsum(np.diff(ends) == 0)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(held))

    return sets


def _sketches(sets: DataFrame, t: float, reach: bool, made: Callable[[pa.Array], pa.Array] = _listed) -> DataFrame:
    """(group, words, id, _blk, n, sketch) of each set (id, _blk, items, n) for
    its own size group or, with ``reach``, the groups that it may match. ``made``
    gives the sets of a column of items, ``n`` being their size or what is above."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [1]
        for batch in batches:
            given, ids, blocks, sizes = (batch.column(c) for c in ("items", "id", "_blk", "n"))
            for a, b in row_slices(sizes.to_numpy().astype(np.int64)):
                at, groups, words, data = [], [], [], []
                lists = made(given.slice(a, b - a))
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                edges = edges if len(n) == 0 or edges[-1] > n.max() / t + 1 else size_groups(int(n.max() / t) + 1, t)
                items, ends = lists.flatten().to_numpy(), np.cumsum(n)
                with np.errstate(over="ignore"):
                    mixed = mix64(items.view(np.uint64))
                for i, end in enumerate(ends.tolist()):
                    size = int(n[i])
                    sizes_met = (max(1, int(np.ceil(size * t - EPS))), int(size / t + EPS)) if reach else (size, size)
                    for group in range(bisect_right(edges, sizes_met[0]) - 1, bisect_right(edges, sizes_met[1])):
                        w = _sketch_words(edges, group, t)
                        odd = np.bincount((mixed[end - size : end] & np.uint64(64 * w - 1)).astype(np.int64), minlength=64 * w) & 1
                        at.append(i)
                        groups.append(group)
                        words.append(w)
                        data.append(np.packbits(odd.astype(np.uint8)).tobytes())
                rows = pa.array(at, pa.int64())
                cols = [pa.array(groups, pa.int32()), pa.array(words, pa.int32()), ids.slice(a, b - a).take(rows), blocks.slice(a, b - a).take(rows), pa.array(n[at].astype(np.int32)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["group", "words", "id", "_blk", "n", "sketch"])

    kind = dict(sets.dtypes)["_blk"]
    return sets.select("id", "_blk", "items", "n").mapInArrow(over, f"group int, words int, id long, _blk {kind}, n int, sketch binary")


def _as_words(table: pa.Table, w: int) -> np.ndarray:
    """The sketches of a tile, one row a word."""
    data = b"".join(table.column("sketch").to_pylist())
    return np.ascontiguousarray(np.frombuffer(data, np.uint64).reshape(-1, w).T)


def sketch_candidates(left: DataFrame, right: DataFrame, t: float, self_join: bool, made: Callable[[pa.Array], pa.Array] = _listed) -> DataFrame:
    """(l_id, r_id) of sets (id, _blk, items, n) that may reach the threshold;
    none that does is missing. Of a self-join the smaller id first. ``made`` as
    in ``_sketches``."""

    def near(lt: pa.Table, rt: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if lt.num_rows and rt.num_rows:
            w = lt.column("words")[0].as_py()
            rt = rt.take(pc.sort_indices(rt.column("n")))
            ids, n = rt.column("id").to_numpy(), rt.column("n").to_numpy().astype(np.int64)
            sketch, mine = _as_words(rt, w), np.ascontiguousarray(_as_words(lt, w).T)
            sizes = lt.column("n").to_numpy().astype(np.int64)
            first, last = np.searchsorted(n, np.ceil(sizes * t - EPS)), np.searchsorted(n, np.floor(sizes / t + EPS), "right")
            share = (1 - t) / (1 + t)
            for i, key in enumerate(lt.column("id").to_numpy()):
                a, b = first[i], last[i]
                # What differs in too many bits after a few words is left out of the others.
                left, differ, most = None, np.zeros(b - a, np.int16 if w <= 256 else np.int64), (sizes[i] + (n[b - 1] if b > a else 0)) * share + EPS
                for word in range(w):
                    theirs = sketch[word, a:b] if left is None else sketch[word, left]
                    differ += np.bitwise_count(theirs ^ mine[i, word])
                    if word % SOME_WORDS == SOME_WORDS - 1 and word + 1 < w:
                        still = np.flatnonzero(differ <= most)
                        if 4 * len(still) < len(differ):
                            left, differ = still + a if left is None else left[still], differ[still]
                left = np.arange(a, b) if left is None else left
                hits = ids[left[differ <= may_differ(sizes[i] + n[left], t)]]
                hits = hits[hits > key] if self_join else hits
                found.append((np.full(len(hits), key), hits))
        cols = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2
        return pa.table({"l_id": pa.array(cols[0], pa.int64()), "r_id": pa.array(cols[1], pa.int64())})

    dealt = lambda df, reach: _sketches(df, t, reach, made).where("_blk IS NOT NULL").withColumn("deal", F.col("id"))
    ls, rs = written(dealt(left, False)), written(dealt(right, True))
    return by_tiles(ls, rs, ["_blk", "group", "words"], near, "l_id long, r_id long", F.col("words")).distinct()


def _cell_sides(pairs: DataFrame, left: DataFrame, right: DataFrame, self_join: bool) -> tuple[DataFrame, DataFrame]:
    """(l_id, lc) and (r_id, rc): the side of a cell that each row of the pairs
    (l_id, r_id) belongs to. Rows go by their least neighbour, so that a class
    of similar rows shares few cells, and those with the same one are dealt out
    by their size ``n``."""
    if self_join:
        ends = pairs.select(F.col("l_id").alias("id"), F.col("r_id").alias("near")).unionByName(pairs.select(F.col("r_id").alias("id"), F.col("l_id").alias("near")))
        least = written(ends.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("near")))
        leasts = [least, least]
    else:
        leasts = [written(pairs.groupBy(F.col(a).alias("id")).agg(F.min(b).alias("near"))) for a, b in (("l_id", "r_id"), ("r_id", "l_id"))]
    out = []
    for least, sets, side in zip(leasts, (left, right), "lr", strict=True):
        dealt = least.join(sets.select("id", "n"), "id").groupBy("near").agg(F.ceil(F.sum("n") / F.lit(CELL_WORDS)).cast("long").alias("_t"))
        at = F.xxhash64("near", F.pmod(F.xxhash64("id"), F.greatest(F.col("_t"), F.lit(1).cast("long"))))
        out.append(least.join(dealt, "near").select(F.col("id").alias(f"{side}_id"), at.alias(f"{side}c")))
    return out[0], out[1]


def in_cells(pairs: DataFrame, left: DataFrame, right: DataFrame, self_join: bool, count: Callable, limit: Callable, made: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """(l_key, r_key, _blk, l_n, r_n, inter) of the pairs (l_id, r_id) of rows
    (id, k, _blk, items, n) of one block without null keys, where ``limit(l_n,
    r_n, inter)`` holds (on arrays). ``count`` gives ``inter`` for the rows of
    a cell: from both sides' lists of items, and pairs of their places in order
    of the left ones. Rows of one id are paired each, as by a join. With
    ``made`` it is these lists that count, and ``n`` is their length."""
    pairs = written(pairs)
    ls, rs = _cell_sides(pairs, left, right, self_join)
    met = written(pairs.join(ls, "l_id").join(rs, "r_id").select("l_id", "r_id", F.xxhash64("lc", "rc").alias("cell")))
    rows = lambda df, side, is_left: met.select(F.col(f"{side}_id").alias("id"), F.col("cell").alias("at")).distinct().join(df.select("id", "k", "_blk", "items", "n"), "id").where("k IS NOT NULL AND _blk IS NOT NULL").withColumn("is_left", F.lit(is_left))
    both = rows(left, "l", True).unionByName(rows(right, "r", False))

    def over(ids: pa.Table, sets: pa.Table) -> pa.Table:
        sets = sets.take(pc.sort_indices(sets.column("id")))
        mine = sets.column("is_left").to_numpy()
        lt, rt = sets.filter(pa.array(mine)), sets.filter(pa.array(~mine))
        at = [np.empty(0, np.int64)] * 2
        if ids.num_rows and lt.num_rows and rt.num_rows:
            # All rows of the left id with all of the right one.
            span = lambda t, c: [np.searchsorted(t.column("id").to_numpy(), ids.column(c).to_numpy(), side) for side in ("left", "right")]
            (a, b), (c, d) = span(lt, "l_id"), span(rt, "r_id")
            n = (b - a) * (d - c)
            one = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            at = [a[one] + k // (d - c)[one], c[one] + k % (d - c)[one]] if len(one) else at
        codes = pa.concat_arrays([lt.column("_blk").combine_chunks(), rt.column("_blk").combine_chunks()]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        same = codes[at[0]] == codes[lt.num_rows + at[1]]
        i, j = at[0][same], at[1][same]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        l_n, r_n = lt.column("n").to_numpy()[i], rt.column("n").to_numpy()[j]
        sides = [x.column("items").combine_chunks() for x in (lt, rt)]
        if made and len(i):
            sides = [made(x) for x in sides]
            l_n, r_n = (x.value_lengths().to_numpy(zero_copy_only=False)[at] for x, at in zip(sides, (i, j), strict=True))
        inter = count(*sides, i, j) if len(i) else np.empty(0, np.int64)
        kept = np.flatnonzero(limit(l_n, r_n, inter))
        l_at, r_at = pa.array(i[kept]), pa.array(j[kept])
        cols = [lt.column("k").take(l_at), rt.column("k").take(r_at), lt.column("_blk").take(l_at), pa.array(l_n[kept], pa.int32()), pa.array(r_n[kept], pa.int32()), pa.array(inter[kept], pa.int32())]
        return pa.table(cols, ["l_key", "r_key", "_blk", "l_n", "r_n", "inter"])

    types = dict(left.dtypes)
    schema = f"l_key {types['k']}, r_key {dict(right.dtypes)['k']}, _blk {types['_blk']}, l_n int, r_n int, inter int"
    return met.groupBy("cell").cogroup(both.groupBy("at")).applyInArrow(over, schema)


def common_items(left: pa.Array, right: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many items the sets left[i] and right[j] have in common; ``i``
    ascends."""
    ends = [np.cumsum(np.concatenate([[0], x.value_lengths().to_numpy(zero_copy_only=False)])).astype(np.int64) for x in (left, right)]
    mine, theirs = left.flatten().to_numpy(), right.flatten().to_numpy()
    code = np.unique(np.concatenate([mine, theirs]), return_inverse=True)[1]
    mine, theirs = code[: len(mine)], code[len(mine) :]
    held, out = np.zeros(len(code) + 1, bool), np.empty(len(i), np.int64)
    first = np.flatnonzero(np.diff(i, prepend=-1))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(i)], strict=True):
        items = mine[ends[0][i[a]] : ends[0][i[a] + 1]]
        held[items] = True
        n = ends[1][j[a:b] + 1] - ends[1][j[a:b]]
        for c, d in row_slices(n):
            some = j[a + c : a + d]
            size = n[c:d]
            place = np.arange(size.sum()) + np.repeat(ends[1][some] - np.cumsum(size) + size, size)
            hits = np.concatenate([[0], np.cumsum(held[theirs[place]])])
            out[a + c : a + d] = np.diff(hits[np.concatenate([[0], np.cumsum(size)])])
        held[items] = False
    return out


ENTRY = ["commit_id", "is_priority", "ts", "r1", "r2", "r3"]


def nearest_two(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """For ``left`` (name, key, fp) the rows of ``right`` (name, nblob, fp, w,
    commit_id, is_priority, ts, r1, r2, r3) of its name with another nblob than
    its key, ``most`` bits away at most: per tile the sum of ``w`` (``n``, on
    one row) and the first two in the order of F3 (priority ones by distance,
    r1, r2, r3, others by ts, the newest first, before these) with their
    distance ``d``."""
    types = dict(right.dtypes)

    def over(lt: pa.Table, rt: pa.Table) -> pa.Table:
        fps = rt.column("fp").to_numpy().view(np.uint64)
        rank = np.empty(len(fps), np.int64)
        rank[pc.sort_indices(rt, [(c, "ascending") for c in ("r1", "r2", "r3", "commit_id")], null_placement="at_start").to_numpy()] = np.arange(len(fps))
        newest = np.unique(-rt.column("ts").to_numpy(), return_inverse=True)[1].astype(np.int64)
        prio = rt.column("is_priority").to_numpy().astype(bool)
        base = rank + np.where(prio, 0, (1 << 62) | (newest << (RANK_BITS + DIST_BITS)))
        weight, same = rt.column("w").to_numpy(), {}
        for j, key in enumerate(rt.column("nblob").to_pylist()):
            same.setdefault(key, []).append(j)
        rows, picks, counts, dists = [], [], [], []
        for i, (fp, key) in enumerate(zip(lt.column("fp").to_numpy().view(np.uint64), lt.column("key").to_pylist(), strict=True)):
            d = np.bitwise_count(fps ^ fp)
            hits = np.flatnonzero(d <= most)
            if key in same:
                hits = np.setdiff1d(hits, same[key])
            if len(hits):
                order = base[hits] + (d[hits].astype(np.int64) << RANK_BITS)
                best = hits[np.argpartition(order, 1)[:2]] if len(hits) > 2 else hits
                rows += [i] * len(best)
                picks += best.tolist()
                counts += [int(weight[hits].sum()), 0][: len(best)]
                dists += d[best].tolist()
        mine, theirs = lt.select(["name", "key"]).take(pa.array(rows, pa.int64())), rt.select(ENTRY).take(pa.array(picks, pa.int64()))
        return pa.table([*mine.columns, pa.array(counts, pa.int64()), pa.array(dists, pa.int32()), *theirs.columns], ["name", "key", "n", "d", *ENTRY])

    schema = f"name {types['name']}, key {dict(left.dtypes)['key']}, n long, d int, " + ", ".join(f"{c} {types[c]}" for c in ENTRY)
    return by_tiles(left.withColumn("deal", F.col("key")), right.withColumn("deal", F.col("nblob")), ["name"], over, schema)


def _blocks(sets: DataFrame) -> DataFrame:
    """(no, keys, fps): the rows (k, fp) sorted by key and cut into blocks, which
    are numbered in this order. Rows of one key are one block's."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows: pa.Table) -> pa.RecordBatch:
            ends = pa.array([0, rows.num_rows], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in ("k", "fp")], ["keys", "fps"])

        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) < BLOCK_ROWS:
                continue
            rows, a = pa.concat_tables(held).combine_chunks(), 0
            keys = rows.column("k").combine_chunks()
            new = np.concatenate([np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1, [len(keys)]])
            while len(keys) - a > BLOCK_ROWS and (b := int(new[np.searchsorted(new, a + BLOCK_ROWS)])) < len(keys):
                yield block(rows.slice(a, b - a))
                a = b
            held = [rows.slice(a)]
        if held and sum(x.num_rows for x in held):
            yield block(pa.concat_tables(held).combine_chunks())

    kind = dict(sets.dtypes)["k"]
    rows = sets.select("k", "fp").where("k IS NOT NULL AND fp IS NOT NULL").repartitionByRange("k").sortWithinPartitions("k")
    packed = written(rows.mapInArrow(pack, f"keys array<{kind}>, fps array<bigint>"))
    order = Window.orderBy("k")  # over the blocks' first keys alone
    return written(packed.join(F.broadcast(packed.select(F.col("keys")[0].alias("k")).select("k", (F.row_number().over(order) - 1).alias("no"))), F.col("keys")[0] == F.col("k")).select("no", "keys", "fps"))


def _near(mine: np.ndarray, theirs: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the rows at most ``most`` bits apart, for some columns
    j after others."""
    step = max(1, STEP_CELLS // max(1, len(mine)))
    for a in range(0, len(theirs), step):
        d = np.bitwise_count(mine[:, None] ^ theirs[None, a : a + step])
        hits = np.flatnonzero(d <= most)
        i, j = np.divmod(hits, d.shape[1])
        yield i, j + a, d.ravel()[hits]


class _Given:
    """Rows of some columns, given in batches of ``GIVEN_ROWS`` or a few more."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.rows, self.held = names, [], 0

    def add(self, *cols: pa.Array) -> Iterator[pa.RecordBatch]:
        self.rows.append(cols)
        self.held += len(cols[0])
        if self.held >= GIVEN_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*self.rows, strict=True)], self.names)
        self.rows, self.held = [], 0


def _score(d: np.ndarray) -> pa.Array:
    return pa.array(1.0 - d / 64.0, pa.float64())


def _sides(lefts: DataFrame, rights: DataFrame, on: Column) -> DataFrame:
    """Pairs of blocks. Each task has one left block or a few, and reads all of
    one right partition for each, in its order; nothing is shuffled for it."""
    n = max(1, lefts.count())
    ls = lefts.repartition(n).select(F.col("no").alias("l"), F.col("keys").alias("l_keys"), F.col("fps").alias("l_fps"))
    return ls.hint("shuffle_replicate_nl").join(rights, on)


def _row(batch: pa.RecordBatch, side: str, at: int) -> tuple[pa.Array, np.ndarray]:
    return batch.column(f"{side}_keys")[at].values, batch.column(f"{side}_fps")[at].values.to_numpy().view(np.uint64)


def near_simhashes(sets: DataFrame, most: int) -> DataFrame:
    """(l_key, r_key, score) of all pairs of rows (k, fp) with l_key < r_key and
    ``most`` bits of difference at most."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Given(["l_key", "r_key", "score"])
        for batch in batches:
            for at, (l, r) in enumerate(zip(batch.column("l").to_pylist(), batch.column("r").to_pylist(), strict=True)):
                (lk, lf), (rk, rf) = (_row(batch, s, at) for s in ("lr" if l <= r else "rl"))
                for i, j, d in _near(lf, rf, most):
                    if l == r:  # in order of the keys, of which equal ones aren't a pair
                        some = np.flatnonzero(i < j)
                        some = some[pc.not_equal(lk.take(pa.array(i[some])), rk.take(pa.array(j[some]))).to_numpy(zero_copy_only=False)]
                        i, j, d = i[some], j[some], d[some]
                    if len(i):
                        yield from out.add(lk.take(pa.array(i)), rk.take(pa.array(j)), _score(d))
        yield from out.rest()

    blocks, kind = _blocks(sets), dict(sets.dtypes)["k"]
    rights = blocks.select(F.col("no").alias("r"), F.col("keys").alias("r_keys"), F.col("fps").alias("r_fps")).coalesce(1)
    # Each pair of blocks once, every block having half of the others.
    l, r = F.col("l"), F.col("r")
    once = (l == r) | (((l + r) % 2 == 0) == (l < r)) & (l != r)
    return _sides(blocks, rights, once).mapInArrow(over, f"l_key {kind}, r_key {kind}, score double")


def ranked_simhashes(sets: DataFrame, most: int) -> DataFrame:
    """F1 over the pairs of ``near_simhashes``: (doc, other, score, rank) of the
    near rows of every row, best first, ties in the order of the other's key.
    A task meets all blocks in order twice, first to count a row's near ones by
    distance, then to number them: a rank is what is nearer, what is as near in
    blocks before, and the place among the others of the block."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, seen = _Given(["doc", "other", "score", "rank"]), None, None
        group = counts = before = np.empty(0, np.int64)
        for batch in batches:
            for at, (l, turn, r) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("l", "turn", "r")), strict=True)):
                (lk, lf), (rk, rf) = _row(batch, "l", at), _row(batch, "r", at)
                if l != now:
                    now, seen, before = l, (-1, -1), None
                    # Rows of one key are one list.
                    group = np.concatenate([[0], np.cumsum(pc.not_equal(lk[1:], lk[:-1]).to_numpy(zero_copy_only=False))]).astype(np.int64)
                    counts = np.zeros((int(group[-1]) + 1) * (most + 1), np.int64)
                if (turn, r) <= seen:
                    raise RuntimeError(f"block {r} of turn {turn} behind {seen}")
                seen = (turn, r)
                if turn and before is None:
                    by_row = counts.reshape(-1, most + 1)
                    before = (np.cumsum(by_row, axis=1) - by_row).ravel()
                for i, j, d in _near(lf, rf, most):
                    if l == r:
                        some = np.flatnonzero(pc.not_equal(lk.take(pa.array(i)), rk.take(pa.array(j))).to_numpy(zero_copy_only=False))
                        i, j, d = i[some], j[some], d[some]
                    if not len(i):
                        continue
                    at_list = group[i] * (most + 1) + d
                    if not turn:
                        counts += np.bincount(at_list, minlength=len(counts))
                        continue
                    order = np.lexsort((j, at_list))
                    at_list, i, j, d = at_list[order], i[order], j[order], d[order]
                    n = np.bincount(at_list, minlength=len(counts))
                    rank = before[at_list] + np.arange(len(at_list)) - (np.cumsum(n) - n)[at_list] + 1
                    before += n
                    yield from out.add(lk.take(pa.array(i)), rk.take(pa.array(j)), _score(d), pa.array(rank, pa.int64()))
        yield from out.rest()

    blocks, kind = _blocks(sets), dict(sets.dtypes)["k"]
    twice = blocks.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), F.col("no").alias("r"), F.col("keys").alias("r_keys"), F.col("fps").alias("r_fps"))
    # As they come from a map, their order isn't dropped for the join's sake.
    rights = twice.coalesce(1).sortWithinPartitions("turn", "r").mapInArrow(lambda batches: batches, twice.schema)
    return _sides(blocks, rights, F.lit(True)).mapInArrow(over, f"doc {kind}, other {kind}, score double, rank long")
