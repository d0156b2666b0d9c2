"""Operator 12: the prefix trie of conversations, in balanced parentheses.

A conversation is its path of turn digests (16 bytes a turn; texts never travel
further than their digest and word count). Equal paths become one row with the
number, the smallest and the SHA-256 of their ids. Paths in their order are cut
into shards of consecutive ones; a shard streams them into a balanced
parentheses sequence, an opening and a closing one per node in preorder. There

* ``find_close``, over blocks of the excess with a tree of their minima, gives
  the closing parenthesis of each node and with it the extent of its subtree;
* the rank of leaf pairs, an opening one followed by its closing one, counts
  the leaves of a subtree;
* cumulative arrays over preorder give its conversations and savings, range
  minima its smallest conversation.

A node that other shards hold too lies on its shard's first or last path, the
spine. All other nodes are finished in their shard; what hangs off the spine is
folded into loads of the spine's nodes. The spines, two paths a shard, are the
paths of the next level, where loads of one node add up; levels follow until
the rest fits one shard. So no task holds more than a shard of ``SHARD_NODES``
nodes and a path, and a group of equal conversations is one row by then.

The id lists to digest are put in order by a range partitioning on (path, id),
joined there into chunks, and only those chunks of a path, in order, meet in
one task, which streams them through the digest.

Cases: null role or text counts as empty. Turns go by number, nulls first, ties
by their digest; repeated rows are repeated turns. A null conv_id takes no
part. Negative ids belong to the group of the next id above that ``GROUP``
divides. An empty table gives no rows. Other columns are ignored, whatever
their names. The digests of one conversation (20 bytes a turn) must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blobtrail.llm.common import WORD, table, written

# --- fixed values ----------------------------------------------------------
GROUP, HEADS = 20, 4  # conversations of a group share crc32 % HEADS first turns
WHITE = " \t\n\x0b\x0c\r"
TURN = 16  # bytes of a turn digest
BLOCK = 64  # parentheses of an excess block
SHARD_NODES, SHARD_PATHS = 1 << 17, 16  # a shard is cut beyond both
LEVEL_PATHS = 1024  # paths of a partition from the second level on
LAST_PATHS = 4096  # so many paths at most make the last level
CHUNK_IDS = 1 << 16
SALTS = 32
# ---------------------------------------------------------------------------
LOADS = "array<struct<depth int, n long, first long, kids long, leaves long, saved long, ends binary>>"
NODE = f"conv_id long, depth long, parent_conv_id long, key binary, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, path binary, words array<int>, loads {LOADS}"
NONE = np.iinfo(np.int64).max


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path and words per turn of every rebuilt conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    n_words = F.when(text.rlike(WORD), F.size(F.split(F.trim(text, F.lit(WHITE)), r"[\x20\x09-\x0D]+"))).otherwise(0)
    each = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), digest.alias("g"), n_words.alias("w"))
    own = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "g", "w"))).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda x: F.struct(x["g"].alias("g"), x["w"].alias("w"))).alias("t"))
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("t", 1, HEADS - 1).alias("head"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    rest = F.slice("t", F.col("h") + 1, F.size("t"))
    whole = own.join(heads, "base", "left").select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("t", 1, 0)), rest).alias("t"))
    return whole.select("conv_id", F.unhex(F.array_join("t.g", "")).alias("path"), F.col("t.w").alias("words"))


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def equal_paths(each: DataFrame) -> DataFrame:
    """Per distinct path: ``first``, ``n`` and ``ends`` of its conversations'
    ids (the smallest, their number, SHA-256 of all, ascending)."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.binary(), pa.int64(), pa.int64(), pa.string()], ["end", "first", "n", "ids"]
        now, held, done = None, [], []
        for batch in batches:
            for end, conv in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if end != now or len(held) >= CHUNK_IDS:
                    if held:
                        done.append((now, held[0], len(held), ",".join(map(str, held))))
                    now, held = end, []
                held.append(conv)
            if done:
                yield _batch(done, kinds, names)
                done = []
        if held:
            yield _batch([(now, held[0], len(held), ",".join(map(str, held)))], kinds, names)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [pa.int64(), pa.int64(), pa.binary()], ["first", "n", "ends"]
        now, least, total, state, done = None, None, 0, None, []
        for batch in batches:
            for end, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("end", "first", "n", "ids")), strict=True):
                if end != now:
                    if now is not None:
                        done.append((least, total, state.digest()))
                    now, least, total, state = end, first, 0, hashlib.sha256()
                state.update((("," if total else "") + ids).encode())
                total += n
            if done:
                yield _batch(done, kinds, names)
                done = []
        if now is not None:
            yield _batch([(least, total, state.digest())], kinds, names)

    ids = each.select(F.unhex(F.md5("path")).alias("end"), "conv_id")
    parts = ids.repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(chunks, "end binary, first long, n long, ids string")
    return parts.repartition("end").sortWithinPartitions("end", "first").mapInArrow(digests, "first long, n long, ends binary")


def find_close(bits: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Positions of the closing parentheses of ``opens`` in ``bits`` (1 opens,
    0 closes), by block minima of the excess and a tree over them."""
    excess = np.cumsum(2 * bits.astype(np.int32) - 1)
    target, big = excess[opens] - 1, np.iinfo(np.int32).max
    n_blocks = -(-len(bits) // BLOCK)
    padded = np.full(n_blocks * BLOCK, big, np.int32)
    padded[: len(bits)] = excess
    leaves = 1 << max(0, n_blocks - 1).bit_length()
    tree = np.full(2 * leaves, big, np.int32)
    tree[leaves : leaves + n_blocks] = padded.reshape(n_blocks, BLOCK).min(axis=1)
    level = leaves
    while level > 1:
        level //= 2
        tree[level : 2 * level] = tree[2 * level : 4 * level].reshape(level, 2).min(axis=1)
    close, todo, beyond = np.full(len(opens), -1), np.arange(len(opens)), []

    def scan(todo: np.ndarray, start: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Looks for each target from ``start`` to its block's end; returns
        the ones not found."""
        left = []
        for k in range(BLOCK):
            at = start + k
            inside = at < (block + 1) * BLOCK
            left.append(todo[~inside])
            todo, start, block, at = todo[inside], start[inside], block[inside], at[inside]
            hit = padded[at] == target[todo]
            close[todo[hit]] = at[hit]
            todo, start, block = todo[~hit], start[~hit], block[~hit]
            if not len(todo):
                break
        return np.concatenate([*left, todo])

    beyond = scan(todo, opens + 1, opens // BLOCK)
    node, found = leaves + opens[beyond] // BLOCK, np.zeros(len(beyond), bool)
    while not found.all():
        right = (node % 2 == 0) & ~found & (tree[np.minimum(node + 1, 2 * leaves - 1)] <= target[beyond])
        node = np.where(right, node + 1, np.where(found, node, node // 2))
        found |= right
    while len(node) and (node < leaves).any():
        node = np.where(node >= leaves, node, np.where(tree[np.minimum(2 * node, 2 * leaves - 1)] <= target[beyond], 2 * node, 2 * node + 1))
    scan(beyond, (node - leaves) * BLOCK, node - leaves)
    return close


def range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of values[start:end], end over start, by a sparse table."""
    rows, size = [values], 1
    while 2 * size <= len(values):
        rows.append(np.minimum(rows[-1][: len(rows[-1]) - size], rows[-1][size:]))
        size *= 2
    width = np.frexp(end - start)[1] - 1  # floor of the binary logarithm
    out = np.empty(len(start), values.dtype)
    for k, row in enumerate(rows):
        at = np.nonzero(width == k)[0]
        out[at] = np.minimum(row[start[at]], row[end[at] - (1 << k)])
    return out


def shared_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid - 1)
    return low


def prefix_keys(path: bytes) -> list[bytes]:
    """Names of the nodes on a path, from the root."""
    state, out = hashlib.md5(), []
    for at in range(0, len(path) + 1, TURN):
        out.append(state.digest())
        state.update(path[at : at + TURN])
    return out


class Shard:
    """The trie of consecutive paths, while they stream by."""

    def __init__(self):
        self.first_path = self.path = None
        self.first_words = self.words = None
        self.parent, self.depth, self.w, self.loads, self.keys, self.n_paths = [-1], [0], [0], [], [], 0
        self.bits, self.stack = bytearray([1]), [0]

    def add(self, path: bytes, words: list[int], loads: list[dict], named: bool) -> None:
        if self.first_path is None:
            self.first_path, self.first_words, shared = path, words, 0
        else:
            shared = shared_turns(self.path, path)
        keys = prefix_keys(path) if named else None
        if named and not self.keys:
            self.keys.append(keys[0])
        self.bits += bytes(len(self.stack) - 1 - shared)
        del self.stack[shared + 1 :]
        for d in range(shared + 1, len(path) // TURN + 1):
            self.parent.append(self.stack[-1])
            self.depth.append(d)
            self.w.append(words[d - 1])
            if named:
                self.keys.append(keys[d])
            self.stack.append(len(self.w) - 1)
            self.bits.append(1)
        self.path, self.words = path, words
        self.n_paths += 1
        for x in loads:
            self.loads.append((self.stack[x["depth"]], x["n"], x["first"], x["kids"], x["leaves"], x["saved"], x["ends"]))

    def finish(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of the finished nodes and, but at the last level, the spine."""
        m = len(self.w)
        bits = np.frombuffer(bytes(self.bits) + bytes(len(self.stack)), np.uint8)
        opens = np.nonzero(bits)[0]
        close = find_close(bits, opens)
        start, end = np.arange(m), np.searchsorted(opens, close)
        n, kids, leaves, saved, first = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64), np.full(m, NONE)
        ends = [None] * m
        if self.loads:
            node, *sums, digests = zip(*self.loads, strict=True)
            node = np.array(node)
            for into, values in zip((n, kids, leaves, saved), (sums[0], sums[2], sums[3], sums[4]), strict=True):
                np.add.at(into, node, np.array(values, np.int64))
            np.minimum.at(first, node, np.array([NONE if x is None else x for x in sums[1]], np.int64))
            for x, digest in zip(node.tolist(), digests, strict=True):
                ends[x] = ends[x] or digest
        parent, w = np.array(self.parent), np.array(self.w, np.int64)
        spine = np.zeros(m, bool)
        if not last:
            spine[: len(self.first_path) // TURN + 1] = True
            spine[self.stack] = True
        inside = lambda a: (c := np.concatenate([[0], np.cumsum(a)]))[end] - c[start]
        n_convs, smallest = inside(n), range_min(first, start, end)
        # Leaf pairs of nodes whose children, if any, are not folded away.
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[opens + 1] = (bits[opens + 1] == 0) & (kids == 0)
        rank = np.cumsum(pair)
        n_leaves = rank[close] - rank[opens] + inside(leaves)
        total = inside(np.where(spine, 0, (n_convs - 1) * w) + saved)
        children = kids + np.bincount(parent[1:], minlength=m)
        ok = ~spine
        by_key = np.array([p >= 0 and bool(spine[p]) for p in self.parent]) if not last else np.zeros(m, bool)
        names = dict(zip(self.stack, prefix_keys(self.path), strict=True)) | dict(enumerate(prefix_keys(self.first_path)))
        parents = [None if p < 0 or k else int(smallest[p]) for p, k in zip(self.parent, by_key.tolist(), strict=True)]
        cols = [
            pa.array(smallest), pa.array(np.array(self.depth, np.int64)), pa.array(parents, pa.int64()), pa.array(self.keys or [None] * m, pa.binary()),
            pa.array([names[p] if k else None for p, k in zip(self.parent, by_key.tolist(), strict=True)], pa.binary()),
            pa.array(n_convs), pa.array(children), pa.array(n_leaves), pa.array(total), pa.array(ends, pa.binary()),
        ]
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.binary())])
        load = pa.list_(pa.struct([("depth", pa.int32()), *((c, pa.int64()) for c in ("n", "first", "kids", "leaves", "saved")), ("ends", pa.binary())]))
        rest = [("path", pa.binary()), ("words", pa.list_(pa.int32())), ("loads", load)]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(m, t) for _, t in rest)], schema=pa.schema([*schema, *rest])).filter(pa.array(ok))
        if last:
            return
        # What hangs off the spine is folded into its nodes.
        off = np.nonzero(ok & by_key)[0]
        for into, values in ((n, n_convs), (leaves, n_leaves), (saved, total), (kids, np.ones(m, np.int64))):
            np.add.at(into, parent[off], values[off])
        np.minimum.at(first, parent[off], smallest[off])
        top = list(range(len(self.first_path) // TURN + 1))
        sides = [(self.first_path, self.first_words, top), (self.path, self.words, self.stack[len(set(top) & set(self.stack)) :])]
        out = []
        for path, words, nodes in sides[: 1 if self.first_path == self.path else 2]:
            held = [x for x in nodes if n[x] or kids[x]]
            out.append((path, words, [{"depth": self.depth[x], "n": n[x], "first": first[x], "kids": kids[x], "leaves": leaves[x], "saved": saved[x], "ends": ends[x]} for x in held]))
        spines = [pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), rest, strict=True)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(out), t.type) for t in schema), *spines], schema=pa.schema([*schema, *rest]))


def level(rows: DataFrame, parts: int | None, last: bool, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """Finished nodes (path null) and spines of one level of paths, dealt to
    ``parts`` ranges; the first level (None) leaves their number to Spark."""
    named = parts is not None

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for path, words, loads in zip(*(batch.column(c).to_pylist() for c in ("path", "words", "loads")), strict=True):
                if shard is not None and len(shard.w) >= shard_nodes and shard.n_paths >= SHARD_PATHS and not last:
                    yield from shard.finish(last)
                    shard = None
                shard = shard or Shard()
                shard.add(path, words, loads, named)
        if shard is not None:
            yield from shard.finish(last)

    dealt = rows.coalesce(1) if last else rows.repartitionByRange(parts, "path") if named else rows.repartitionByRange("path")
    return dealt.sortWithinPartitions("path").mapInArrow(stream, NODE)


def trie(turns: DataFrame, shard_nodes: int = SHARD_NODES, last_paths: int = LAST_PATHS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ``ends`` (null where no conversation ends)."""
    each = written(paths(turns))
    load = F.struct(F.size("words").alias("depth"), "n", "first", *[F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")], "ends")
    rows = each.join(equal_paths(each), F.col("conv_id") == F.col("first")).select("path", "words", F.array(load).cast(LOADS).alias("loads"))
    nodes, last, parts = None, False, None
    while True:
        done = written(level(rows, parts, last, shard_nodes))
        finished = done.where("path IS NULL").drop("path", "words", "loads")
        nodes = finished if nodes is None else nodes.unionByName(finished)
        if last:
            break
        rows = done.where("path IS NOT NULL").select("path", "words", "loads")
        n_paths = rows.count()
        last, parts = n_paths <= last_paths, -(-n_paths // LEVEL_PATHS)
    # Children of spine nodes learn their parent's conv_id; a parent may have
    # most nodes for children, so both sides are salted.
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    named_by = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"), salt)
    open_ = nodes.where("parent_key IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    closed = open_.join(named_by, ["parent_key", "_salt"]).withColumn("parent_conv_id", F.col("_parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    return nodes.where("parent_key IS NULL").select(*columns).unionByName(closed.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trie(table(spark, sf_dir, "conversations"))
    return nodes.withColumn("ends_sha256", F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit(""), 256))).drop("ends")


ORACLE_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), g AS (
  SELECT conv_id, turn, md5(strlen(role) || ':' || role || text) AS g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t
), c AS (
  SELECT conv_id, list({{'g': g, 'w': w}} ORDER BY turn NULLS FIRST, g) AS t,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % {HEADS} AS h
  FROM g GROUP BY conv_id
), p AS (
  SELECT c.conv_id, list_concat(coalesce(b.t[1 : c.h], []), c.t[c.h + 1 :]) AS t FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % {GROUP}
), e AS (
  SELECT conv_id, len(t) AS len, d, array_to_string(list_transform(t[1 : d], lambda x: x.g), '') AS k, coalesce(t[d].w, 0) AS w
  FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM p)
), n AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM e GROUP BY k, d
), f AS (
  SELECT n.k, n.d, n.conv_id, p.conv_id AS parent_conv_id, n.n_convs, n.w, n.ends_sha256 FROM n LEFT JOIN n p ON n.d > 0 AND p.k = left(n.k, 32 * (n.d - 1))
), m AS (SELECT left(k, 32 * (d - 1)) AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1
), a AS (
  SELECT left(f.k, 32 * j) AS k, CASE WHEN m.k IS NULL THEN 1 ELSE 0 END AS leaf, (f.n_convs - 1) * f.w AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM f) f LEFT JOIN m ON m.k = f.k
), s AS (SELECT k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY k)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, f.parent_conv_id, f.n_convs, CAST(coalesce(m.n_children, 0) AS BIGINT) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.k = f.k LEFT JOIN m ON m.k = f.k
"""
