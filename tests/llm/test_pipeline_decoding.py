"""What the last stage's ids decode to."""

import hashlib

import corpus_pipeline


def test_ids_decode_to_the_text(spark):
    texts = ["plain words, it's 12", "é 字 😀\n\t x", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
