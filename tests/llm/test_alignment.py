import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from blobtrail.llm import alignment


@pytest.fixture(scope="module")
def plain():
    """(text) -> (A tokens, B tokens) as lists of (id, bytes), by the libraries alone; None where they don't give the text back."""
    a = Tokenizer.from_file(alignment.A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.B_FILE)
    alphabet = alignment.byte_alphabet()

    def tokens(text):
        if not text:
            return None
        left = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else None

    return tokens


def groups_of(left, right):
    ends = lambda side: [sum(len(x) for _, x in side[: k + 1]) for k in range(len(side))]
    a_end, b_end = ends(left), ends(right)
    cuts = sorted(set(a_end) & set(b_end))
    out, low = [], 0
    for cut in cuts:
        out.append(([i for (i, _), e in zip(left, a_end) if low < e <= cut], [i for (i, _), e in zip(right, b_end) if low < e <= cut]))
        low = cut
    return out


def brute(rows, tokens):
    per_doc, docs = [], Counter()
    for _, text in rows:
        found = tokens(text)
        groups = groups_of(*found) if found else []
        links = Counter((a, b) for left, right in groups for a in left for b in right)
        docs.update(links.keys())
        per_doc.append((groups, links))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (doc, _), (groups, links) in zip(rows, per_doc, strict=True):
        form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), hashlib.sha256(form.encode()).hexdigest() if form else "",
            sum(n for p, n in links.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in links.items()),
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in alignment.align(df).collect()), key=repr)


HARD = [
    "", None, " ", "  ", "\n", "a\nb", "a\n\nb", "a \nb", "a\n b ", " lead", "\nlead", "tail ", "tail\n", "tabs\tand\x0bmore\rend", "x  y   z", "▁mark", "a ▁ b", "nul\x00in",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "Ünïcödé ñ 漢字かな交じり文 한국어 العربية", "\U0001f600\U0001f601 \U0001f9d1‍\U0001f680", "non break　wide \x85 \x1c odd",
    "don't we'll I'M 12345 3.14 !!!??? ----", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "é ﬁ Ａ", "﻿bom ​zero", "ab" * 500, "漢" * 300,
]


def test_against_the_libraries(spark, plain, sample):
    rows = [(k, t) for k, t in enumerate(HARD)] + [(3, "a\n\nb"), (None, "no id of its own")]
    rows += [(100 + r["doc_id"], r["text"][:1500]) for r in sample.limit(60).collect()]
    rng = random.Random(13)
    letters = " \n\t\r▁ab'SÉ1.漢é\U0001f600\x85  "
    rows += [(1000 + k, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))) for k in range(300)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, pair int, run string").repartition(3)
    assert got(df) == brute(rows, plain)


def test_awkward_rows(spark, plain, docs, no_docs):
    rows = [(r["doc_id"], (r["text"] or "")[:4000]) for r in docs.collect()]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows, plain)
    assert alignment.align(docs).count() == docs.count()
    assert got(no_docs) == []


def test_small_runs_and_caches_give_the_same(spark, sample, monkeypatch):
    want = got(sample)
    for name, value in (("RUN_POSTINGS", 500), ("RUN_DOCS", 7), ("CACHE_UNITS", 50), ("TEXT_AT_ONCE", 3000), ("JOINED", 40), ("BIG_GROUP", 2)):
        monkeypatch.setattr(alignment, name, value)
    aligner = alignment.Aligner(*(open(f, "rb").read() for f in (alignment.A_FILE, alignment.B_FILE)))
    texts = [r["text"] for r in sample.collect()]
    whole = [r[:5] for r in aligner.documents(texts)[0]]
    parts = [r[:5] for t in texts for r in aligner.documents([t])[0]]
    assert whole == parts
    assert sorted((r[1:6] for r in want), key=repr) == sorted(whole, key=repr)


def test_planes_against_a_table():
    rng = np.random.default_rng(13)
    for n_docs in (1, 9, 3000):
        table = Counter()
        for _ in range(4000):
            pair = int(rng.zipf(1.3)) % 50
            table[(int(rng.integers(n_docs)), pair)] += int(rng.integers(1, 9))
        place, pair = (np.array([k[c] for k in table]) for c in range(2))
        links = np.array(list(table.values()))
        planes = alignment.Planes.of(n_docs, place, pair, links)
        planes = alignment.Planes.unpacked(n_docs, planes.pairs, planes.packed())
        assert planes.doc_counts().tolist() == [(pair == p).sum() for p in planes.pairs]
        assert planes.link_counts().tolist() == [links[pair == p].sum() for p in planes.pairs]
        score = rng.integers(0, 1000, (len(planes.pairs), 2))
        want = np.zeros((n_docs, 2), np.int64)
        for (d, p), n in table.items():
            want[d] += score[np.searchsorted(planes.pairs, p)] * n
        assert (planes.returned(score) == want).all()


def test_pair_table(spark, plain):
    rows = [(1, "the cat sat"), (2, "the cat"), (3, "the the the"), (4, "anblewh")]
    found = {(r["id_a"], r["id_b"]): (r["n_docs"], r["n_links"], r["is_best"]) for r in alignment.pair_table(alignment.runs(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    docs, links = Counter(), Counter()
    for _, text in rows:
        here = Counter((a, b) for left, right in groups_of(*plain(text)) for a in left for b in right)
        docs.update(here.keys())
        links.update(here)
    assert found == {p: (docs[p], links[p], docs[p] == max(n for (a, _), n in docs.items() if a == p[0])) for p in docs}
