"""Helpers that the operators share: tables, partition counts, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Bytes of a batch for Python workers.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Whether a finished query's shuffle files are deleted at once; what is written is read from the shared folder alone.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_noted: list[list] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, which its user sizes with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs in one process.

    On a cluster a folder of the driver's own disk would lose the executors' files, so that is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            held = spark.sparkContext.getCheckpointDir()
        named = held
    return named.rstrip("/")


@contextmanager
def settings_for_a_while(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings while it lasts, and with its own again after it."""
    held = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def bounded(spark: SparkSession) -> None:
    """For the rest of the session batches for Python are bounded by bytes as well as rows, so that long texts don't fill a worker."""
    spark.conf.set(BATCH, BATCH_BYTES)


def collected(spark: SparkSession) -> None:
    """Executors collect their garbage, one task for each core: heap and generated code that earlier work left go back to the machine, where Python workers need them."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and nothing is computed twice.

    Files in the shared folder outlive executors, so a lost executor costs only its running tasks. The shuffle files
    of the writing go when it is done. by: a column whose values get folders of their own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings_for_a_while(spark, {BATCH: BATCH_BYTES, CLEANUP: "true"}):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for tables in _noted:
        tables.append(out)
    return out


@contextmanager
def noted() -> Iterator[list[DataFrame]]:
    """The list of tables that are written while it lasts."""
    _noted.append(tables := [])
    try:
        yield tables
    finally:
        _noted.remove(tables)


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``written`` once nothing reads them any more: what was made of them must be written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
