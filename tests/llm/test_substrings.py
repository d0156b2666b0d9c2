import hashlib
import random

import pytest

from blobtrail.llm import substrings
from llm_rows import texts_of


def brute(rows):
    w = substrings.WINDOW
    first = {}
    for doc, text in rows:
        words = text.encode().split()
        for i in range(len(words) - w + 1):
            if doc is not None:
                key = tuple(words[i : i + w])
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        words = text.encode().split()
        gone = set()
        for i in range(len(words) - w + 1):
            if doc is not None and first[tuple(words[i : i + w])] < doc:
                gone.update(range(i, i + w))
        kept = b" ".join(x for i, x in enumerate(words) if i not in gone)
        out.append((str(doc), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup(df).collect())


def rows_of(seed, n=60):
    """Documents from few words and shared passages, so that runs overlap,
    nest and repeat inside documents."""
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                a = rng.randint(0, len(p) - 1)
                words += p[a : rng.randint(a, len(p))]
            else:
                words += [rng.choice("abc") for _ in range(rng.randint(1, 20))]
        rows.append((rng.randint(0, 40), " ".join(words)))
    return rows


@pytest.mark.parametrize("shard_docs", [1000, 3])
def test_against_all_windows(spark, monkeypatch, shard_docs):
    monkeypatch.setattr(substrings, "SHARD_DOCS", shard_docs)
    rows = rows_of(shard_docs)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_awkward_rows(docs, no_docs):
    assert found(docs) == brute(texts_of(docs))
    assert found(no_docs) == []


def test_kept_text(docs):
    for r in substrings.dedup(docs, with_text=True).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_automaton_knows_first_documents():
    rng = random.Random(9)
    texts = [[rng.choice("ab").encode() for _ in range(rng.randint(5, 60))] for _ in range(30)]
    automaton, seen = substrings.Automaton(), {}
    for doc, words in enumerate(texts):
        runs = [tuple(words[i : i + substrings.WINDOW]) for i in range(len(words) - substrings.WINDOW + 1)]
        assert automaton.first_docs(words) == [seen.get(r) for r in runs]
        automaton.add(words, doc)
        for r in runs:
            seen.setdefault(r, doc)


def test_heavy_windows_and_evenly_spaced_ids(spark, monkeypatch):
    """Windows of nearly all documents, by the broadcast automaton and by the
    shards alike; ids all multiples of 20; one document repeats a line."""
    rng = random.Random(10)
    line = " ".join(f"shared{i}" for i in range(16))
    rows = [(20 * d, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 30))) + " " + line + f" own{d} " + line) for d in range(60)]
    rows += [(7, (line + " again ") * 300), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for heavy in (1, 50, 2000):
        monkeypatch.setattr(substrings, "HEAVY", heavy)
        monkeypatch.setattr(substrings, "SHARD_DOCS", 4)
        assert found(df) == brute(rows)


def test_a_repeated_line_is_sent_once(spark):
    line = " ".join(f"r{i}" for i in range(20)) + " "
    rows = spark.createDataFrame([(1, line * 400), (2, line * 400)], "doc_id long, text string")
    read = substrings.read_texts(rows)
    for cold, hot in (("keys", "array()"), ("array()", "keys")):
        sent = substrings.segments(read.selectExpr("doc_id", "version", "packed", f"cast({cold} AS array<bigint>) AS cold", f"cast({hot} AS array<bigint>) AS hot"))
        per = {r["doc_id"]: r["count"] for r in sent.groupBy("doc_id").count().collect()}
        assert set(per) == {1, 2} and max(per.values()) <= 30
