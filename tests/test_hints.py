"""The cascade with hint paths against one query at a time, by plain loops."""

import random

import bruteforce as BF
import pytest
from blobtrail.functions.content import blob_id
from blobtrail.operators.cascade import MatchParams, match_cascade
from pyspark.sql import functions as F

PRIORITY_FROM = 24


def alone(query, versions, touches, k, threshold):
    """(mode, preferred, number of candidates) of one query. ``versions``:
    commit -> {path: content}; ``touches``: commit -> paths, newest first."""
    _, path, content, own, hint = query
    lf = lambda t: t.replace("\r\n", "\n").replace("\r", "\n")
    text = lf(content)
    newest = sorted(versions, reverse=True)

    def preferred(found):
        found = [c for c in found if c != own]
        if not found:
            return None
        prio = [c for c in found if c >= PRIORITY_FROM]
        return (prio[0] if prio else max(found, key=lambda c: (stamp(c), -found.index(c)))), len(found)

    exact = [c for c in newest if any(versions[c][p] == text for p in touches[c] if p in versions[c])]
    if preferred(exact):
        return ("exact_blob", *preferred(exact))
    base = path.rsplit("/", 1)[-1] or (hint or "").rsplit("/", 1)[-1]
    known = sorted({p for v in versions.values() for p in v}, reverse=True)  # the order of the path objects
    paths = ([hint] if hint else []) + [p for p in known if base and p.rsplit("/", 1)[-1] == base and p != hint]
    touched = list(dict.fromkeys(c for p in paths for c in newest if p in touches[c]))
    hits, fuzzy = [], []
    for c in touched:
        here = [versions[c][p] for p in paths if p in versions[c]]
        if text in here:
            hits.append(c)
        elif here and lf(here[0]) == text:
            hits.append(c)
        elif here:
            score = BF.jaccard(set(BF.shingles(BF.tokens(text), k)), set(BF.shingles(BF.tokens(lf(here[0])), k)))
            fuzzy.append((score, c))
    if preferred(hits):
        return ("normalized_path", *preferred(hits))
    ranked = [c for s, c in sorted(fuzzy, key=lambda x: -x[0]) if s >= threshold]
    if preferred(ranked):
        return ("normalized_path", *preferred(ranked))
    return ("no_match", None, 0)


def stamp(c):
    return (c * 7) % 5


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaid_queries_equal_queries_run_alone(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    bodies = [" ".join(rng.choice(words) for _ in range(12)) for _ in range(4)]

    def body():
        out = rng.choice(bodies).split()
        if rng.random() < 0.5:
            out[rng.randrange(12)] = rng.choice(words)
        return " ".join(out[:6]) + rng.choice(["\n", "\r\n"]) + " ".join(out[6:])

    names = [f"{d}/{f}" for d in "abc" for f in ("x.txt", "y.txt")]
    versions = {c: {p: body() for p in rng.sample(names, rng.randint(1, 4))} for c in range(30)}
    touches = {c: rng.sample(sorted(v), rng.randint(1, len(v))) for c, v in versions.items()}
    queries = [(q, rng.choice(["x.txt", "q/y.txt", "", "z.txt"]), body(), rng.randrange(30), rng.choice([None, "", "no/such.txt", *names])) for q in range(160)]
    queries += [(160 + i, *queries[5][1:]) for i in range(20)]  # one hot group

    fv = spark.createDataFrame([(c, p, t) for c, v in versions.items() for p, t in v.items()], "commit_id long, path string, content string")
    fv = fv.withColumn("blob_id", blob_id(F.col("content"))).withColumn("log_ord", -F.col("commit_id"))
    at = spark.createDataFrame([(c, p) for c, ps in touches.items() for p in ps], "commit_id long, path string")
    changes = fv.join(at, ["commit_id", "path"]).select("commit_id", "path", F.lit(None).cast("string").alias("old_path"), "blob_id", F.lit("add").alias("kind"), "log_ord")
    order = {p: i for i, p in enumerate(sorted(names, reverse=True))}
    objects = fv.join(spark.createDataFrame(list(order.items()), "path string, ord long"), "path").select("blob_id", "path", "ord")
    attrs = spark.createDataFrame([(c, stamp(c), c >= PRIORITY_FROM) for c in versions], "commit_id long, ts long, is_priority boolean")
    files = spark.createDataFrame(queries, "query_id long, path string, content string, self_commit long, hint string")
    out = match_cascade(files, fv, changes, objects, attrs, MatchParams(threshold=0.35, shingle_size=2))
    got = {r.query_id: (r.mode, r.preferred, r.candidates_count) for r in out["summary"].collect()}
    want = {q[0]: alone(q, versions, touches, 2, 0.35) for q in queries}
    modes = {m for m, *_ in want.values()}
    assert modes == {"exact_blob", "normalized_path", "no_match"}
    assert got == want
