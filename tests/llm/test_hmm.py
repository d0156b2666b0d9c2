import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from blobtrail.llm import hmm
from llm_rows import texts_of


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    monkeypatch.setattr(hmm, "SYMBOLS", 3)
    rng = np.random.default_rng(0)
    draw = lambda *s: (x := rng.random(s)) / x.sum(axis=-1, keepdims=True)
    return hmm.Model(draw(2), draw(2, 2), draw(2, 3).T)


def paths(seq, m):
    for states in itertools.product(range(2), repeat=len(seq)):
        p = m.start[states[0]] * m.emit[seq[0], states[0]]
        for a, b, x in zip(states, states[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[x, b]
        yield states, p


def test_forward_and_expectations_equal_sums_over_paths(small):
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 3, n) for n in (1, 5, 3, 8, 5)]
    logs = hmm.log_likelihoods(seqs, small)
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for seq, log in zip(seqs, logs):
        total = sum(p for _, p in paths(seq, small))
        assert log == pytest.approx(math.log10(total))
        for states, p in paths(seq, small):
            start[states[0]] += p / total
            for a, b in zip(states, states[1:]):
                move[a, b] += p / total
            for x, s in zip(seq, states):
                emit[x, s] += p / total
    for got, want in zip(hmm.expected_counts(seqs, small), (start, move, emit)):
        assert np.allclose(got, want, atol=1e-4)


def base(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter()
    for d, t in rows:
        if not held(d):
            c.update(t.encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for d, t in rows:
        tokens = [*t.encode().lower().split(), None]
        yield d, (held(d), len(tokens), sum(c[x] > 0 for x in tokens), n, pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens)))


def test_base_score_and_gain_on_held_out_texts(sample, monkeypatch):
    monkeypatch.setattr(hmm, "KNOWN", 40_000)  # so that some words go the way of the join
    want = dict(base(texts_of(sample)))
    rows = hmm.score(sample).collect()
    for r in rows:
        assert tuple(r)[1:6] == want[r["doc_id"]]
        assert math.isfinite(r["score"]) and r["score"] < 0
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_rounds_raise_the_likelihood(sample):
    train = lambda k: sum(r["score"] for r in hmm.score(sample, rounds=k).collect() if not r["held_out"])
    assert train(1) < train(3)


def test_awkward_rows(docs, no_docs):
    rows = hmm.score(docs, rounds=1).collect()
    want = sorted(base(texts_of(docs)), key=str)
    assert len(rows) == len(want)
    by_id = dict(want)
    for r in rows:
        assert tuple(r)[1:6] == by_id[r["doc_id"]] and math.isfinite(r["score"])
    assert hmm.score(no_docs, rounds=1).count() == 0


def test_pieces_change_nothing(small, monkeypatch):
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 3, n) for n in (1, 7, 40, 41, 95)]
    whole = hmm.expected_counts(seqs, small)
    for piece in (1, 2, 10, 40, 95):
        monkeypatch.setattr(hmm, "PIECE", piece)
        for got, want in zip(hmm.expected_counts(seqs, small), whole):
            assert np.allclose(got, want, atol=1e-4), piece


def test_score_against_plain_recursions(spark):
    """The whole score: Baum-Welch and the forward recursion in plain float64
    loops; words of held-out texts alone have a class for a symbol."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(25)]
    rows = [(d, " ".join(rng.choice(words, rng.integers(0, 40))) + (f" only{d}" if d % 3 == 0 else "")) for d in range(60)] + [(7, "w1 w2"), (None, "W3 no id")]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts, ends = Counter(), 0
    for d, t in rows:
        if not held(d):
            counts.update(t.lower().split())
            ends += 1
    order = sorted(counts, key=lambda w: (-counts[w], w))
    # Every counted word is a symbol of its own, so classes count nothing.
    symbol = lambda w: order.index(w) if w in counts else hmm.END + 1 + hmm.class_of(w.encode())
    seqs = [[*(symbol(w) for w in t.lower().split()), hmm.END] for _, t in rows]

    class Given:
        words = [w.encode() for w in order]
        symbol_n = np.zeros(hmm.SYMBOLS)

    Given.symbol_n[: len(order)] = [counts[w] for w in order]
    Given.symbol_n[hmm.END] = ends
    m = hmm.first_model(Given)
    start, move, emit = m.start, m.move, m.emit
    for _ in range(2):
        s0, mv, em = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.SYMBOLS, hmm.STATES))
        for (d, _), x in zip(rows, seqs):
            if held(d):
                continue
            alpha, scales = [start * emit[x[0]]], []
            for t in range(len(x)):
                if t:
                    alpha.append((alpha[-1] @ move) * emit[x[t]])
                scales.append(alpha[-1].sum())
                alpha[-1] = alpha[-1] / scales[-1]
            beta = np.ones(hmm.STATES)
            em[x[-1]] += alpha[-1]
            for t in range(len(x) - 2, -1, -1):
                mv += np.outer(alpha[t], emit[x[t + 1]] * beta) * move / scales[t + 1]
                beta = move @ (emit[x[t + 1]] * beta) / scales[t + 1]
                em[x[t]] += alpha[t] * beta
            s0 += alpha[0] * beta
        start, move, emit = s0 + hmm.TRANSITION_ADD, mv + hmm.TRANSITION_ADD, em + hmm.EMISSION_ADD
        start, move, emit = start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    want = []
    for (d, t), x in zip(rows, seqs):
        a, total = start * emit[x[0]], 0.0
        for k, s in enumerate(x):
            a = a if k == 0 else (a @ move) * emit[s]
            total += math.log10(a.sum())
            a = a / a.sum()
        unseen = sum(w not in counts for w in t.lower().split())  # the only member of an empty class: ADD / (ADD * 1)
        want.append((str(d), total + unseen * math.log10(hmm.ADD / (hmm.ADD * 1))))
    got = [(str(r["doc_id"]), r["score"]) for r in hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=2).collect()]
    assert [d for d, _ in sorted(got)] == [d for d, _ in sorted(want)]
    for (_, x), (_, y) in zip(sorted(got), sorted(want)):
        assert x == pytest.approx(y, abs=2e-3)
