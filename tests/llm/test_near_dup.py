import itertools
import random

from blobtrail.llm import near_dup
from blobtrail.llm.graph import components


def brute(rows):
    """Classes of (doc_id, text) rows by all pairs of full shingle sets."""
    sets = []
    for doc, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        grams = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else ({tuple(words)} if words else set())
        sets.append((doc, grams))
    smallest = {d: d for d, _ in sets}

    def find(x):
        while smallest[x] != x:
            x = smallest[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            p, q = sorted((find(a), find(b)))
            smallest[q] = p
    return sorted((d, len(g), find(d), find(d) == d) for d, g in sets)


def family(rng, size, edits, words=120):
    base = [f"t{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(5000)}"
        yield " ".join(copy)


def test_chained_families_match_all_pairs(spark):
    rng = random.Random(3)
    texts = [t for edits in (1, 2, 3, 4, 6) for t in family(rng, 30, edits)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    rng = random.Random(4)
    rows = list(enumerate(t for edits in (3, 5) for t in family(rng, 40, edits)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_awkward_rows(docs, no_docs):
    got = {}
    for r in near_dup.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert got[1][0][1:] == (1, True) and got[2] == [(got[1][0][0], 1, False)] * 2
    assert got[4] == [(0, 4, True)] and got[5] == [(0, 5, True)] and got[6] == [(0, 6, True)]
    assert got[8][0][1] == 7 and got[9] == [(1, 9, True)] and got[None][0][1:] == (None, True)
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_stage_keeps_one_of_each_group(spark, docs):
    left = near_dup.stage(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "4", "5", "6", "7", "9", "10", "None"])  # 3 and 11 are near copies of 1


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (100, 100)]
    got = {r["v"]: r["m"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_stage_takes_five_words(spark):
    rng = random.Random(8)
    rows = []
    for edits in (2, 6, 9, 10, 11, 14):  # one-word changes apart; 9 to 11 lie between the rules of four and five words
        base = [f"u{edits}x{i}" for i in range(400)]
        copy = list(base)
        for i in range(edits):
            copy[20 + 25 * i] = f"c{rng.randrange(10**6)}"
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for _, t in rows]
    want = [d for d, _ in rows if not any(100 * len(sets[d] & sets[e]) >= 80 * len(sets[d] | sets[e]) for e in range(d))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dup.stage(spark, df, "").collect()) == want
    four = sum(r["kept"] for r in near_dup.near_duplicates(df).collect())
    assert four < len(want)


def test_one_id_with_different_texts(spark):
    """Texts under one id are judged by themselves: no unique text goes, and
    groups that only an id has in common stay apart."""
    rng = random.Random(5)
    p, q, unique, other = (" ".join(f"{c}{rng.randrange(9999)}" for _ in range(60)) for c in "pquo")
    near_p = p.rsplit(" ", 1)[0] + " changed"
    rows = [(1, p), (2, p), (2, unique), (3, q), (2, q), (4, near_p), (4, other), (4, other), (1, near_p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df).collect())
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (2, 2, True), (4, 1, False), (4, 4, True), (4, 4, True), (1, 1, True)])
    left = sorted(tuple(r) for r in near_dup.stage(spark, df, "").collect())
    (first,) = [t for d, t in left if t in (p, near_p)]
    assert left == sorted([(1, first), (2, unique), (2, q), (4, other)])
