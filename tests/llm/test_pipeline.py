import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from locusflow.llm import mixing

from . import data


def test_stages_take_effect(spark, tmp_path):
    """Each stage against brute force on its own input; extra columns and odd rows pass."""
    import public_tokenizers

    rows = [(i, t, "en", s, len(t or "")) for i, t, s in data.corpus()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "ngram_jaccard", "substring_dedup", "source_mix", "byte_bpe"]

    clean = stage["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows)  # no toxic labels: nothing goes
    one = stage["ngram_jaccard"](spark, docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in one) == sorted(i for i, (_, c) in data.classes(data.corpus()).items() if i == c)
    want = {i: v for i, v in data.substring_dedup(data.corpus()).items() if v[1] == 0 or v[1] < v[0]}
    left = {r["doc_id"]: r for r in stage["substring_dedup"](spark, docs, str(tmp_path)).collect()}
    texts = {i: t for i, t, _ in data.corpus()}
    assert {i: r["text"] for i, r in left.items()} == {i: v[2] if v[1] else texts[i] for i, v in want.items()}
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.values())
    copies = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mixing.mix(docs, docs.columns).collect()}
    mixed = stage["source_mix"](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {i: n for i, n in copies.items() if n}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4")) for r in out) and public_tokenizers.PATTERN
