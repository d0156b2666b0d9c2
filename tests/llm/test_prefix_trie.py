import hashlib
import random
import zlib

import numpy as np
import pytest

from blobtrail.llm import prefix_trie


def rebuilt(rows):
    """conv_id -> turns, by plain loops."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            g = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), g, (role or "", text or "")))
    own = {c: [t for *_, t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - c % 20 if c >= 0 else c + -c % 20
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode().split()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(ids), len(node), parent, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got(df, **sizes):
    empty = hashlib.sha256(b"").hexdigest()
    rows = [tuple(r) for r in prefix_trie.trie(df, **sizes).collect()]
    out = {(*r[:7], bytes(r[7]).hex() if r[7] is not None else empty) for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, words string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "w", 2) for r in rows], SCHEMA)


def random_rows(seed, convs):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.choice([0, 1, 2, 3, 4, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "a b c", "", None, "x\ty"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard_nodes": 4, "last_paths": 4}, {"shard_nodes": 40, "last_paths": 12}])
def test_against_plain_loops(spark, sizes, monkeypatch):
    if sizes:
        monkeypatch.setattr(prefix_trie, "LEVEL_PATHS", 16)
    rows = random_rows(12, range(300))
    rows += [(c, t, "user", "same") for c in range(400, 500) for t in range(3)]  # one hot conversation
    assert got(frame(spark, rows), **sizes) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "no id"), (5, None, "user", "no number"), (5, 0, "user", "x"), (5, 0, "user", "x"), (-7, 0, "user", "y"), (-20, 3, None, None)]
    rows += [(40, t, "user", f"turn {t} " + "word " * (t % 50)) for t in range(700)] + [(41, t, "user", f"turn {t} " + "word " * (t % 50)) for t in range(650)]
    rows += [(60, 0, "user", "w " * 100_000)]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, [])) == set()
    # A conversation whose turns all come from an absent first one is turnless.
    lone = next(c for c in range(1000, 2000) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 2)
    assert got(frame(spark, [(lone, 0, "user", "a"), (lone, 1, "user", "b")])) == {(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())}


def test_find_close_against_a_stack():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, 700, 5000):
        bits, depth = [], 0
        for _ in range(n):
            if depth and rng.random() < 0.5:
                bits.append(0)
                depth -= 1
            else:
                bits.append(1)
                depth += 1
        bits = np.array(bits + [0] * depth, np.uint8)
        stack, want = [], {}
        for at, b in enumerate(bits.tolist()):
            if b:
                stack.append(at)
            else:
                want[stack.pop()] = at
        opens = np.nonzero(bits)[0]
        assert prefix_trie.find_close(bits, opens).tolist() == [want[x] for x in opens.tolist()]


def test_range_min():
    v = np.random.default_rng(6).integers(0, 99, 300)
    a, b = np.triu_indices(300)
    assert (prefix_trie.range_min(v, a, b + 1) == np.array([v[x : y + 1].min() for x, y in zip(a, b, strict=True)])).all()
