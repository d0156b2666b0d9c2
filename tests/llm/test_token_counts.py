import random
import zlib

import pytest
from pyspark.sql import functions as F

from blobtrail.llm import token_counts as tc


@pytest.fixture(scope="module")
def count():
    return tc.counter(open(tc.RANKS_FILE, "rb").read())


def check(nodes, text, count):
    """The tree is that of a full encoding, and its inner nodes are sums."""
    assert list(nodes[1]) == [len(text), len(count.pattern.findall(text)), len(count.encoding.encode_ordinary(text))]
    for i in range(1, len(nodes) // 2):
        assert (nodes[i] == nodes[2 * i] + nodes[2 * i + 1]).all()


def test_edits_equal_a_full_encoding(count):
    rng = random.Random(5)
    parts = [" ", "a", "foo", "'s", "'", "  \n", "1", "é", ".", "x y z", "", "漢 ", "word ", " the", "\n"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 600)))
        nodes = tc.build(text, count)
        check(nodes, text, count)
        for _ in range(3):  # rounds of edits on the updated tree
            at = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 4))))
            edits = [(at[i], at[i + 1] if rng.random() < 0.5 else at[i], "".join(rng.choices(parts, k=rng.randint(0, 3)))) for i in range(0, len(at) - 1, 2)]
            new, nodes, _ = tc.edited(text, nodes, edits, count)
            for a, b, r in reversed(edits):
                text = text[:a] + r + text[b:]
            assert new == text
            check(nodes, text, count)


def test_leaf_borders_inside_runs(count):
    for n in (62, 63, 64, 65):  # pre-tokens before the run
        for run, put in (("\n\n", tc.NOTE), ("  ", tc.NOTE), (" \n\t \n", "x"), ("'", "re"), ("'r", "e"), ("'l", "l"), ("'", "s")):
            for tail in ("b", "b" + " c" * 100, ""):
                text = "w" + " w" * (n - 1) + run + tail
                at = n * 2 - 1 + len(run)
                for edit in ((at, at, put), (at, len(text), ""), (at, at + 1, put)):
                    new, nodes, _ = tc.edited(text, tc.build(text, count), [edit], count)
                    check(nodes, new, count)


def test_edits_of_runs(count):
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\n\n", "'", "r", "l", "e", "s", "'r", "b", "."]
    for _ in range(400):
        text = "w" + " w" * 55 + "".join(rng.choices(parts, k=30)) + " w" * 60
        at = sorted(rng.sample(range(100, len(text) - 100), 6))
        edits = [(at[i], at[i + 1] if rng.random() < 0.5 else at[i], "".join(rng.choices(parts, k=rng.randint(0, 2)))) for i in (0, 2, 4)]
        new, nodes, _ = tc.edited(text, tc.build(text, count), edits, count)
        check(nodes, new, count)


def test_only_touched_regions_are_encoded(count):
    text = "some words here " * 5000
    nodes = tc.build(text, count)
    _, after, recoded = tc.edited(text, nodes, [(40000, 40004, "other")], count)
    assert 0 < recoded <= 3 * tc.LEAF


def test_awkward_rows(spark, docs, no_docs, count):
    out = tc.apply_edits(tc.build_trees(docs), tc.masking_edits)
    assert out.count() == docs.count()
    for r in out.collect():
        assert r["tokens_after"] == len(count.encoding.encode_ordinary(r["text"]))
    assert tc.apply_edits(tc.build_trees(no_docs), tc.masking_edits).count() == 0


def test_query_counts(spark, sample, count):
    before = {r["doc_id"]: r["tokens_before"] for r in tc.query(spark, "/root/testdata/sf0.001").collect()}
    assert before == {r["doc_id"]: len(count.encoding.encode_ordinary(r["text"])) for r in sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()}


def test_masking_edits_against_loops():
    rng = random.Random(21)
    for _ in range(300):
        text = " ".join(rng.choice(["12345", "a@b.org", "7@x.de9", "word", "99-88", "1@2.com3 44"]) for _ in range(rng.randrange(30)))
        doc = rng.randrange(1000)
        mails = [(m.start(), m.end(), "<mail>") for m in tc.MAIL.finditer(text)]
        found = mails + [(m.start(), m.end(), "<number>") for m in tc.NUMBER.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in mails)]
        at = zlib.crc32(str(doc).encode()) % (len(text) + 1)
        if not any(a < at < b for a, b, _ in found):
            found.append((at, at, tc.NOTE))
        assert tc.masking_edits(doc, text) == sorted(found)
