"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a single machine a temporary one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once as a table bucketed by ``key`` in the shared folder; joins on the key then move only the other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", scratch(spark, name)).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")  # of the catalog; the files are the folder's
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with an ending that keeps it (and what begins with it) apart from all columns of ``df``."""
    taken, ending = [c.lower() for c in df.columns], ""
    while any(t.startswith(f"__{n}{ending}") for t in taken for n in names):
        ending += "_x"
    return [f"__{n}{ending}" for n in names]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as compressed columns in the shared folder and read again; cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where none is
    set (a test on one machine) a temporary one is made.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Vocabulary(dict):
    """word -> ``make(word)``, made on demand; forgets all past ``most`` words or ``most_bytes`` of them."""

    def __init__(self, make: Callable[[bytes], object], most: int = 400_000, most_bytes: int = 32 << 20):
        super().__init__()
        self.make, self.most, self.most_bytes, self.held = make, most, most_bytes, 0

    def __missing__(self, word):
        if len(self) >= self.most or self.held > self.most_bytes:
            self.clear()
        value = self.make(word)
        if len(word) <= 1 << 12:
            self[word] = value
            self.held += len(word)
        return value

    def clear(self) -> None:
        super().clear()
        self.held = 0


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of texts hold 4 MB, where the session leaves it at the 64 MB that Spark has by itself.

    A batch stands in memory several times, in the JVM and in the worker; 10,000 rows of long texts would else not be bounded by much.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == str(64 << 20):
        spark.conf.set(name, str(4 << 20))


def at_rest() -> None:
    """For the end of a task: a worker that waits for its next one gives back what its batches took."""
    pa.default_memory_pool().release_unused()


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` checkpointed in parts of some ``rows`` rows, where there are more parts than that takes: few rows need few files.

    It is made in as many tasks as its plan has, and kept until it is counted and written.
    """
    shared_folder(df.sparkSession)
    held = df.persist()
    try:
        return held.coalesce(max(1, -(-held.count() // rows))).checkpoint(eager=True)
    finally:
        held.unpersist()


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def skew_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` with a ``lookup`` that has at most one row per key.

    A shadow key makes both sides arrive through an exchange of their own even where the
    lookup is an aggregate over the same key. The runtime can then split a hot key of
    ``rows`` over many tasks (or broadcast a lookup it has measured to be small).
    """
    (name,) = fresh(rows, "shadow")
    shadow = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    out = rows.withColumn(name, shadow).join(lookup.withColumn(name, shadow), [*keys, name], how)
    return out.drop(name)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)
