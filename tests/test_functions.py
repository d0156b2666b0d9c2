import pytest
from pyspark.sql import functions as F

import bruteforce as BF
from blobtrail.functions import content as C
from blobtrail.functions import fingerprints as FP
from blobtrail.functions import text_format as TF
from blobtrail.functions import tokens as T

TOKEN_CASES = [
    ("HTTPRequest2ID_manager", ["http", "request", "2", "id", "manager"]),
    ("fooBar baz_qux", ["foo", "bar", "baz", "qux"]),
    ("XMLHttpRequest", ["xml", "http", "request"]),
    ("snake_case__name", ["snake", "case", "name"]),
    ("ABCDef", ["abc", "def"]),
    ("version2Alpha10", ["version", "2", "alpha", "10"]),
    ("", []),
    ("ＦｏｏＢａｒ", ["foo", "bar"]),  # full-width, needs NFKC
    ("CaféXML", ["caf", "xml"]),  # combining accent composes under NFKC
]


def test_tokenize_table(spark):
    df = spark.createDataFrame([(t,) for t, _ in TOKEN_CASES], "text string")
    got = [r[0] for r in df.select(T.tokenize(F.col("text"))).collect()]
    assert got == [e for _, e in TOKEN_CASES]
    assert got == [BF.tokens(t) for t, _ in TOKEN_CASES]


@pytest.mark.parametrize("k", [-2, 0, 1, 2, 3, 4, 5])
def test_shingles_edges(spark, k):
    toks = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(toks,), ([],)], "t array<string>")
    got = [r[0] for r in df.select(T.shingles(F.col("t"), k)).collect()]
    assert got == [BF.shingles(toks, k), []]


def test_char_ngrams_and_winnow(spark):
    df = spark.createDataFrame([("alpha beta",), ("a",)], "s string")
    one = [set(r[0]) for r in df.select(T.char_ngrams(F.col("s"), 1)).collect()]
    five = [set(r[0]) for r in df.select(T.char_ngrams(F.col("s"), 5)).collect()]
    assert one[0] == set("alpha beta") and five[1] == {"a"}
    w = spark.createDataFrame([(["one two three"],)], "sh array<string>").withColumn("hx", FP.shingle_hex(F.col("sh")))
    got = w.select(FP.winnow_from_hex("hx", 10)).first()[0]
    assert got == [f"{BF.h64('one two three'):016x}"]


def test_blob_ids_and_line_ends(spark):
    df = spark.createDataFrame([("",), ("hello\n",), ("a\r\nb\rc",)], "s string")
    ids = [r[0] for r in df.select(C.blob_id(F.col("s"))).collect()]
    assert ids[:2] == ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391", "ce013625030ba8dba906f756967f9e9ca394464a"]
    assert df.select(C.normalize_lf(F.col("s"))).collect()[2][0] == "a\nb\nc"
    b = spark.createDataFrame([(bytearray(b"a\r\nb\rc\x30\xd0\xa1"),)], "c binary")
    dt = b.schema["c"].dataType
    assert bytes(b.select(C.normalize_lf(F.col("c"), dt)).first()[0]) == b"a\nb\nc\x30\xd0\xa1"


def test_minhash_simhash_match_bruteforce(spark):
    texts = ["a b c d", "a b c e", "x y z w", "", "The quick brown Fox jumps over the lazy dog again"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("tok", T.tokenize(F.col("text")))
    df = T.with_array(df, "tok", F.col("tok"))
    df = T.with_array(df, "th", F.transform("tok", lambda s: T.hash64(s)))
    df = df.withColumn("sig", FP.minhash_signature(F.transform(T.shingle_set(F.col("tok"), 2), lambda s: T.hash64(s)), 32))
    df = df.withColumn("sh", FP.simhash64("th"))
    rows = df.select("text", "sig", "sh").collect()
    for r in rows:
        toks = BF.tokens(r.text)
        assert r.sig == [BF.to_signed(v) for v in BF.minhash(set(BF.shingles(toks, 2)), 32)]
        assert r.sh == BF.to_signed(BF.simhash(toks))


def test_durations_and_formats(spark):
    ms = [0, 999, 1000, 1500, 60000, 62003, 3600000, 3723004, 7200000]
    df = spark.createDataFrame([(m,) for m in ms], "ms long")
    got = [r[0] for r in df.select(TF.humanize_ms(F.col("ms"))).collect()]
    assert got[0] == "wasn't applied or run"
    assert got[1] == "Took 999 milliseconds"
    assert got[2] == "Took 1 seconds"
    assert got[3] == "Took 1 seconds and 500 milliseconds"
    assert "Took 1 minute" in got[4]
    assert got[5] == "Took 1 minute, 2 seconds, and 3 milliseconds"
    assert "Took 1 hour" in got[6]
    assert got[7] == "Took 1 hour, 2 minutes, 3 seconds, and 4 milliseconds"
    assert df.select(TF.format_ms(F.lit(1.234))).first()[0] == "1234 ms"


def test_url_parsing(spark):
    urls = ["https://github.com/a/b.git", "git@github.com:a/b.git", "ssh://git@github.com/a/b", "https://gitlab.com/a/b",
            "https://x.y/z.git", "git@github.com:x/z.git", "/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    rows = df.select(TF.github_owner(F.col("u")), TF.github_repo(F.col("u")), TF.repo_basename(F.col("u"))).collect()
    assert [tuple(r[:2]) for r in rows[:4]] == [("a", "b"), ("a", "b"), ("a", "b"), (None, None)]
    assert [r[2] for r in rows[4:]] == ["z", "z", "repo"]
    names = spark.createDataFrame([("a b/c",), (".hidden",), ("x" * 300,)], "s string")
    got = [r[0] for r in names.select(TF.sanitize_remote_name(F.col("s"))).collect()]
    assert got == ["a_b_c", "_hidden", "x" * 200]
