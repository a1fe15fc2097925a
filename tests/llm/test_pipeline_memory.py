"""What an executor's JVM keeps from one stage of the pipeline to the next."""

import gc

import corpus_pipeline


def test_a_stage_begins_without_what_earlier_work_left(spark):
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    left = [spark._jvm.java.nio.ByteBuffer.allocate(100 << 20) for _ in range(3)]
    del left
    gc.collect()  # Python's proxies hold the buffers
    before = runtime.totalMemory() - runtime.freeMemory()
    docs = spark.createDataFrame([(1, "one word", "en", "a", 8)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.encode(spark, docs, "")
    assert runtime.totalMemory() - runtime.freeMemory() < before - (200 << 20)
