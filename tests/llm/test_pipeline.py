import corpus_pipeline
from blobtrail.llm import pieces


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality rules", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, "/root/testdata/sf0.001")
        assert seen.columns == docs.columns
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() == seen.count()
    assert sorted(r["text"] for r in pieces.decode(rows).collect()) == sorted(r["text"] or "" for r in seen.collect())


def test_awkward_rows_pass_every_stage(spark, docs, no_docs):
    for df in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, "").count() <= 2 * df.count()
