"""A corpus pipeline of five stages over documents; each takes (spark, docs, sf_dir) and its result is written and reread.

Toxic documents go; of each class of near copies the document with the smallest id stays; passages that an earlier
document has go; sources are mixed to their target weights; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm import bpe, jaccard, mixing, rlz, toxicity
from locusflow.llm.common import bounded, collected, forget, noted, table, written

#: SQL can't express the stages; tests/llm hold each against a brute-force version.
ORACLE_SQL = None


def _aside(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """docs with all columns but the needed ones under private names, which no operator's outputs clash with; and the columns that restore docs."""
    # Every stage begins here: long texts don't fill a Python worker, and an executor's JVM doesn't keep what earlier stages left.
    bounded(docs.sparkSession)
    collected(docs.sparkSession)
    names = {c: c if c in needed else f"__carried_{i}" for i, c in enumerate(docs.columns)}
    held = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(name) for c, name in names.items()])
    return held, [F.col(name).alias(c) for c, name in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't call toxic. It learns from the corpus's own labelled documents."""
    held, restored = _aside(docs, "doc_id", "text")
    model = toxicity.fit(held, table(spark, sf_dir, "labels"))
    return toxicity.score(held, model).where("predicted = 0").select(*restored)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked documents.

    A document is known by its id and a hash of its text, so that rows that share an id alone are judged by their
    texts; of rows that share both, the first by content stays. Rows without an id come first and stay.
    """
    held, restored = _aside(docs, "doc_id", "text")
    keyed = held.withColumn("__row", rlz.row_key(F.col("doc_id"), F.col("text")))
    sizes, links = jaccard.linked(keyed, "__row")
    forget(sizes)
    found = written(links.union(links.select("component", "component")).distinct(), "classes")
    forget(links)
    ids = keyed.select(F.col("__row").alias("node"), "doc_id").distinct().join(found, "node")
    kept = ids.groupBy("component").agg(F.min(F.struct("doc_id", "node"))["node"].alias("node"))
    others = written(ids.where("doc_id is not null").select("node").distinct().join(kept, "node", "left_anti").withColumnRenamed("node", "__row"), "others")
    forget(found)
    left = keyed.join(others, "__row", "left_anti")
    again = left.where("doc_id is not null").groupBy("__row").count().where("count > 1").select("__row")
    row = F.struct(*keyed.columns)
    once = left.join(again, "__row", "left_semi").groupBy("__row").agg(F.min_by(row, F.to_json(row)).alias("first")).select("first.*")
    return left.join(again, "__row", "left_anti").unionByName(once).select(*restored)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus; those with nothing left go."""
    held, restored = _aside(docs, "doc_id", "text", "n_chars")
    cleaned = rlz.clean(held)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cleaned.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return left.select(*restored)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents without words have no share in it and stay once."""
    held, restored = _aside(docs, "doc_id", "text", "source")
    mixed = mixing.mix(held, held.columns)
    times = F.when(F.col("size") > 0, F.col("copies")).otherwise(1)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(2)))).where(F.col("__copy") <= times).select(*restored)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ids, the tokens of their text, n_tokens and decoded_sha256, the digest of the bytes that the ids decode to.

    Columns of these names that docs has already become input_ids and so on.
    """
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    made = ("ids", "n_tokens", "decoded_sha256")
    taken, named = {*made, *(c.lower() for c in docs.columns)}, []
    held, restored = _aside(docs, "doc_id", "text")
    for c, column in zip(docs.columns, restored):
        if c.lower() in made:
            c = f"input_{c}"
            while c.lower() in taken:
                c = f"input_{c}"
            column = column.alias(c)
        named.append(column)
    out = bpe.round_trip(held, path, pattern)
    return out.select(*named, "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_class),
    ("substring_dedup", drop_repeated_passages),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's intermediate tables, and its input, go once its result is written."""
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES:
        with noted() as tables:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*before, *tables[:-1])  # what the stage was made of; its own result is the last
        before = [docs]
    return docs
