import collections
import math
import random
import re

import pytest

from blobtrail.llm import quality
from llm_rows import texts_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    tri = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {j for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def brute(rows):
    """Verdicts by plain loops: (doc_id, lang, text)."""
    def histograms(text):
        h = collections.Counter()
        for c in text:
            h[next((k for k, cls in quality.CHAR_CLASSES.items() if re.fullmatch(f"[{cls}]", c)), "other")] += 1
        w = collections.Counter(x if x in quality.COMMON_WORDS else "other" for x in WORD.findall(text))
        return h, w

    def distance(p, q):
        sp, sq = sum(p.values()), sum(q.values())
        if not sp or not sq:
            return 0.0
        d = 0.0
        for k in {*p, *q}:
            a, b = p[k] / sp, q[k] / sq
            d += (a * math.log2(2 * a / (a + b)) if a else 0) / 2 + (b * math.log2(2 * b / (a + b)) if b else 0) / 2
        return math.sqrt(max(0.0, d))

    made = [(doc, lang or "", counts(text), *histograms(text)) for doc, lang, text in rows]
    refs, sizes = {}, collections.Counter()
    failed = lambda c: c[0] < 50 or 100 * c[4] > 50 * c[0]
    for _, lang, c, h, w in made:
        if not failed(c):
            x = refs.setdefault(lang, (collections.Counter(), collections.Counter()))
            x[0].update(h)
            x[1].update(w)
            sizes[lang] += c[0]
    def word_limit(lang, n):
        shares = [refs[lang][1][x] / sizes[lang] for x in [*quality.COMMON_WORDS, "other"]]
        parts = [min((1 - q) / (8 * n * math.log(2)), q) for q in shares]
        limit = math.sqrt(sum(parts) + quality.SPREADS * math.sqrt(2 * sum(x * x for x in parts)))
        return min(quality.MAX_WORD_DISTANCE, max(quality.LEAST_WORD_DISTANCE, limit))

    for doc, lang, c, h, w in made:
        far = sizes[lang] >= quality.MIN_REFERENCE_WORDS and c[0] >= quality.MIN_WORDS and (
            distance(h, refs[lang][0]) > quality.MAX_CHAR_DISTANCE or distance(w, refs[lang][1]) > word_limit(lang, c[0]))
        yield (str(doc), *c, failed(c), not failed(c) and not far)


def verdicts(df):
    feats = quality.features(df)
    out = quality.verdict(feats, quality.references(feats))
    return sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in out.collect())


def test_against_plain_loops(sample):
    rows = [(r["doc_id"], r["lang"], r["text"] or "") for r in sample.collect()]
    assert verdicts(sample) == sorted(brute(rows))


def test_symbols_and_capitals_go_and_prose_stays(sample):
    kept = {r[0]: r[7] for r in verdicts(sample)}
    for doc, text in texts_of(sample):
        if len(WORD.findall(text)) >= 100 and text.count("&&&") > 20:
            assert not kept[str(doc)]


def test_awkward_rows(spark, docs, no_docs):
    rows = [(r["doc_id"], r["lang"], r["text"] or "") for r in docs.collect()]
    assert verdicts(docs) == sorted(brute(rows))
    assert verdicts(no_docs) == []
    assert quality.stage(spark, docs, "").columns == docs.columns
    assert quality.stage(spark, no_docs, "").count() == 0


def test_repeated_windows(spark):
    texts = ["a a a a", "a b c a b c", "a b c d", "x", "", "a b a b a b", "p q r s p q r t q r s"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang")
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.features(df).collect()}
    assert got == {i: counts(t)[4] for i, t in enumerate(texts)}


def test_native_plan(sample, capsys):
    quality.features(sample).explain()
    assert "Python" not in capsys.readouterr().out


def test_distance_is_a_metric_on_shares(spark):
    df = spark.range(1).selectExpr("array(1L, 0L) AS a", "array(0L, 5L) AS b", "array(2L, 0L) AS c")
    r = df.select(quality.js_distance(df.a, df.b), quality.js_distance(df.a, df.c)).first()
    assert r[0] == pytest.approx(1.0) and r[1] == pytest.approx(0.0)


def prose(rng, lang, n):
    """n words, about one in nine of them common ones of the language."""
    common = {"en": ["the", "of", "and", "to"], "de": ["der", "die", "und", "zu"], "es": ["de", "la", "el", "en", "que"], "salad": []}[lang]
    return " ".join(rng.choice(common) if common and rng.random() < 0.12 else "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(3, 8))) for _ in range(n))


def test_stage_rejects_word_salad_and_other_languages(spark):
    rng = random.Random(9)
    clean = [(lang, prose(rng, lang, n)) for lang in ("en", "de", "es") for n in [50, 60, 80] * 40 + [150, 400] * 40 + [3000] * 30]
    salad = [(lang, prose(rng, "salad", n)) for lang in ("en", "de", "es") for n in (130, 300, 1000)]
    other = [(lang, prose(rng, spoken, n)) for lang, spoken in (("en", "de"), ("de", "es"), ("es", "en")) for n in (130, 300, 1000)]
    rows = [(i, *r) for i, r in enumerate(clean + salad + other)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    left = {r["doc_id"] for r in quality.stage(spark, df, "").collect()}
    assert left == set(range(len(clean)))
    assert {int(r[0]) for r in verdicts(df) if r[7]} == left
