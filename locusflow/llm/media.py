"""Media columns: texts stored as progressive JPEG files and read back as payloads and RGB tensors.

Each row is worked on alone: no shuffle, and memory follows the longest text, a few times its size.

Defined results: a null text counts as empty and is stored as one block of zeros; equal texts give equal files
and tensors; repeated rows stay; an empty table gives an empty result; all carried columns pass through, and
one that bears the name of an output column is refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.llm import jpeg
from locusflow.llm.common import table

BATCH_BYTES = 4 << 20


def _mapped(df: DataFrame, source: str, drop: bool, fields: list[T.StructField], convert) -> DataFrame:
    """df with columns made by convert(list of the source's bytes), in Arrow batches of bounded size."""
    kept = [f for f in df.schema.fields if not (drop and f.name == source)]
    if clash := {f.name for f in kept} & {f.name for f in fields}:
        raise ValueError(f"columns {sorted(clash)} exist already")
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, start, raw, size = batch.column(source), 0, [], 0
            for i in range(batch.num_rows):
                raw.append((column[i].as_buffer() or pa.py_buffer(b"")).to_pybytes())
                size += len(raw[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    columns = [pa.array(list(x)) for x in zip(*convert(raw))]
                    yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + columns, names + [f.name for f in fields])
                    start, raw, size = i + 1, [], 0

    return df.mapInArrow(run, T.StructType(kept + fields))


def _store(texts: list[bytes]) -> list[tuple]:
    return list(zip(map(len, texts), jpeg.encode([x + bytes(-len(x) % 64 if x else 64) for x in texts])))


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_bytes and media, the file that holds the text padded with zeros, in place of the text."""
    return _mapped(df, text, True, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())], _store)


def load(df: DataFrame, media: str = "media") -> DataFrame:
    """df with payload, height, width and rgb (3 x height x width bytes) read from the file."""
    fields = [T.StructField("payload", T.BinaryType()), T.StructField("height", T.LongType()), T.StructField("width", T.LongType()), T.StructField("rgb", T.BinaryType())]
    return _mapped(df, media, False, fields, jpeg.decode)


def tensor(row) -> np.ndarray:
    """The RGB tensor of a row of ``load``."""
    return np.frombuffer(row["rgb"], np.uint8).reshape(3, row["height"], row["width"])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: digests of what every document's file gives back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = load(store(docs))
    feature = F.concat_ws(":", F.concat_ws("x", "height", "width"), F.hex(F.crc32("rgb")))
    return back.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
