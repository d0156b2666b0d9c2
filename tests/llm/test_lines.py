import hashlib
import random
import re
from collections import defaultdict

from blobtrail.llm import lines

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(UPPER)


def brute(rows, min_chars, min_docs):
    """Rows of (doc_id, n_lines, n_dropped, kept text), by plain loops."""
    holders = defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        all_lines = (text or "").split("\n")
        gone = lambda x: doc is not None and len(holders[key(x)]) >= min_docs and doc != max(holders[key(x)])
        kept = [x for x in all_lines if not gone(x)]
        out.append((doc, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got(df, **limits):
    return sorted((tuple(r) for r in lines.dedup_lines(df, **limits).collect()), key=repr)


def test_against_plain_loops(spark):
    rng = random.Random(11)
    pool = ["Shared LINE number one", "shared line number one  ", "\tshared line number one\r", "É line that is shared", "é line that is shared", "short", "", "  "]
    rows = [(d, "\n".join(rng.choice([*pool, f"own line {rng.random()}"]) for _ in range(rng.randrange(0, 9)))) for d in range(60)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[4][1]), (61, None), (62, ""), (63, "\n\n"), (64, "Shared line number one\n" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limits in ({"min_chars": 10, "min_docs": 5}, {"min_chars": 1, "min_docs": 2}, {"min_chars": 6, "min_docs": 40}):
        assert got(df, **limits) == brute(rows, **limits)


def test_heavy_and_other_hashes_give_the_same(spark):
    rows = [(d, f"a line of every document\na line of tenth {d % 10}\nown {d}") for d in range(100)]
    hashed = lines.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    as_sets = [{(r["doc_id"], tuple(r["gone"])) for r in lines.dropped(hashed, 5, heavy).collect()} for heavy in (1, 20, 10_000)]
    assert as_sets[0] == as_sets[1] == as_sets[2] and len(as_sets[0]) == 99


def test_awkward_rows(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(docs, min_chars=40, min_docs=2) == brute(rows, 40, 2)
    assert got(docs, min_chars=1, min_docs=1) == brute(rows, 1, 1)
    assert got(no_docs) == []


def test_query_is_native_and_keeps_the_largest_holder(spark, tmp_path):
    line = "This very line stands in all six of the documents."
    rows = [(d, f"own {d}\n  {line.upper() if d % 2 else line}\r\nend") for d in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = lines.query(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toString() and "InArrow" not in df._jdf.queryExecution().toString()
    out = {r["doc_id"]: r for r in df.collect()}
    for d, text in rows:
        kept = text if d == 5 else f"own {d}\nend"
        assert (out[d]["n_lines"], out[d]["n_dropped"]) == (3, int(d != 5))
        assert out[d]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
