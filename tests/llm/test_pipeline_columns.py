"""Columns that bear the operators' names, and rows that share an id, through the stages of the pipeline."""

from pyspark.sql import functions as F

import corpus_pipeline

from . import data

CLASHING = "score predicted n_words n_removed kept __row __spans size source_size target copies taken __copy __carried_3 ids n_tokens input_ids a.b".split()
STAGE = dict(corpus_pipeline.STAGES)


def test_clashing_columns_pass(spark, tmp_path):
    rows = [(i, t, s, len(t or "")) for i, t, s in data.corpus() if i < 45 or i > 79]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    docs = plain.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("toxicity", "ngram_jaccard", "substring_dedup", "source_mix", "byte_bpe"):
        own = STAGE[name](spark, docs, str(tmp_path)).collect()
        assert own
        if name != "byte_bpe":
            assert own[0].__fields__ == docs.columns
            assert all(r[c] == f"{c} of {r['doc_id']}" for r in own for c in CLASHING)
        else:
            assert all(r[{"ids": "input_input_ids", "n_tokens": "input_n_tokens"}.get(c, c)] == f"{c} of {r['doc_id']}" for r in own for c in CLASHING)
            assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in own)
        if name != "source_mix":  # its draws depend on all columns
            want = STAGE[name](spark, plain, str(tmp_path)).collect()
            assert sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in own) == sorted((r["doc_id"], r["text"] or "", r["n_chars"]) for r in want)


def test_rows_that_share_an_id_are_judged_by_their_texts(spark, tmp_path):
    a, b, c = (data.prose(800 + k, 60) for k in range(3))
    rows = [(5, a, 1), (5, b, 2), (5, b, 2), (5, b, 3), (7, b, 4), (3, c, 5), (9, c, 6), (9, a + " end", 7), (None, "no id at all", 8), (None, "no id at all", 9), (8, "", 10), (8, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row int").repartition(3)
    got = STAGE["ngram_jaccard"](spark, docs, str(tmp_path)).collect()
    assert sorted(r["row"] for r in got) == [1, 2, 5, 8, 9, 10, 11]
