import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from blobtrail.llm import pieces
from llm_rows import texts_of

TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n▁ab")), max_size=80)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_any_text_comes_back(vocabulary, text):
    m = pieces.segmenter(vocabulary, 0.3, 5, 0)
    assert m.decode(m.encode(text)) == text


def test_without_dropout_it_is_the_library(vocabulary, sample):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    m = pieces.Segmenter(vocabulary, 0.0, 1, 0)
    for _, text in [*texts_of(sample), (0, " a  b\tc\nd é x "), (0, "   "), (0, "\n\n"), (0, "日本語𝔘x" * 20), (0, "a" * 300)]:
        assert np.frombuffer(m.encode(text), "<u2").tolist() == library.encode(text)


def test_dropout_varies_by_seed_and_repeats_by_seed(vocabulary):
    text = "international considerations regarding tokenization " * 20
    a, b, c = (pieces.Segmenter(vocabulary, 0.2, s, 0).encode(text) for s in (1, 1, 2))
    plain = pieces.Segmenter(vocabulary, 0.0, 1, 0).encode(text)
    assert a == b != c and len(plain) < len(a)


def test_encode_and_decode_tables(docs, no_docs):
    back = pieces.decode(pieces.encode(docs))
    assert sorted(map(str, texts_of(back))) == sorted(map(str, texts_of(docs)))
    rows = pieces.round_trip(docs).collect()
    assert len(rows) == docs.count() and all(r["lossless"] for r in rows)
    assert pieces.round_trip(no_docs).count() == 0


def plain_draws(vocabulary, rate, seed, doc, text):
    """Pieces by one run of the agenda per part, its draws made one by one."""
    m = pieces.Segmenter(vocabulary, rate, seed, doc)
    mask, out, place = (1 << 64) - 1, [], 0

    def mixed(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & mask
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 33

    def skip(candidate):
        key = 0
        for c in candidate:
            key = mixed(key * 0x9E3779B97F4A7C15 + c + 1 & mask)
        return mixed(base ^ key) / 2**64 < rate

    for word in text.split(" "):
        unit, at = pieces.SPACE + word, 0
        for i in range(1, len(unit) + 1):
            if i == len(unit) or unit[i - 1 : i + 1] not in m.pairs:
                place += 1
                base = mixed(pieces.document_key(seed, doc) + place * 0x9E3779B97F4A7C15 & mask)
                out.append(m.segment(unit[at:i], skip))
                at = i
    return b"".join(out)


def test_kept_parts_and_drawn_parts_agree(vocabulary, monkeypatch):
    text = "considerations, of the internationalisation tokenization " + "abcdefgh" * 40 + " naïve 日本語 " + "the of tokenization " * 300 + "end"
    want = plain_draws(vocabulary, 0.3, 7, 12, text)
    assert pieces.Segmenter(vocabulary, 0.3, 7, 12).encode(text) == want
    monkeypatch.setattr(pieces, "KEPT_CHARS", 3)
    assert pieces.Segmenter(vocabulary, 0.3, 7, 12).encode(text) == want
    monkeypatch.setattr(pieces, "UNITS_AT_ONCE", 50)
    monkeypatch.setattr(pieces, "WORDS_AT_ONCE", 20)
    monkeypatch.setattr(pieces, "CACHE_NODES", 5)
    assert pieces.Segmenter(vocabulary, 0.3, 7, 12).encode(text) == want


def test_a_word_is_segmented_in_many_ways(spark, vocabulary):
    texts = [(i, "considerations") for i in range(400)] + [(1000, " ".join(["considerations"] * 400))]
    rows = {r["doc_id"]: r["ids"] for r in pieces.encode(spark.createDataFrame(texts, "doc_id long, text string"), rate=0.3).collect()}
    assert len({tuple(rows[i]) for i in range(400)}) > 20  # over documents
    m = pieces.Segmenter(vocabulary, 0.3, 1)
    inside = [plain for plain in b"".join(m.plain[i] + b"|" for i in rows[1000]).split(b" ")]
    assert len(set(inside)) > 20  # and over the places of one document


def test_long_parts_have_draws_of_their_own(vocabulary):
    text = "ab" * 4000
    m, seen = pieces.Segmenter(vocabulary, 0.5, 3, 1), []
    skip = m._skipper(pieces.document_key(3, 1))
    m.segment(pieces.SPACE + text, lambda c: seen.append(skip(c)) or seen[-1])
    assert 0.45 < sum(seen) / len(seen) < 0.55
    halves = seen[: len(seen) // 2], seen[len(seen) // 2 :]
    assert 0.4 < sum(a == b for a, b in zip(*halves)) / len(halves[0]) < 0.6
