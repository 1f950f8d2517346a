"""JSON documents and JSON-lines tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """A table of JSON lines; blank lines are skipped. A malformed line is an error, or, unless strict, goes to ``quarantine``."""
    reader = spark.read.schema(schema)
    return reader.option("mode", "FAILFAST").json(path) if strict else reader.option("mode", "DROPMALFORMED").json(path)


def quarantine(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line) of the lines that are no rows of the schema."""
    whole = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter(F.trim("line") != "")
    parsed = F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.filter(parsed["_corrupt_record"].isNotNull())


def line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line) of text files, numbered from 1; large files are read in parallel.

    A line's number is its place in its block of the file and the lines of the blocks before.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    place = W.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", "first", (F.sum("n").over(place) - F.col("n")).alias("before"))
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("number"), "line")


def malformed_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, number, line) of the lines that are no rows of the schema."""
    whole = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    rows = line_numbers(spark, path).filter(F.trim("line") != "")
    parsed = F.from_json("line", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return rows.filter(parsed["_corrupt_record"].isNotNull())


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None, sort_keys: bool = True, overwrite: bool = False, ascii_only: bool = False) -> None:
    """One JSON object per row, nulls included, keys sorted or in column order, other characters than ASCII as they are or escaped."""
    rows = df.orderBy(*order) if order else df
    names = sorted(rows.columns) if sort_keys else rows.columns
    value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})
    if ascii_only:  # UTF-16 units, of which characters beyond the first plane have two
        escaped = lambda c: F.concat(F.lit("\\u"), F.array_join(F.regexp_extract_all(F.lower(F.hex(F.encode(c, "UTF-16BE"))), F.lit("(....)"), F.lit(1)), "\\u"))
        value = F.array_join(F.transform(F.split(value, ""), lambda c: F.when(F.octet_length(c) > 1, escaped(c)).otherwise(c)), "")
    rows.select(value.alias("value")).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def write_checked(df: DataFrame, path: str, check: Callable[[DataFrame], None], overwrite: bool = False) -> None:
    """Write a Parquet table beside ``path``, check what was written, and move it there; nothing is left of one that fails.

    A table that is there is moved aside first, put back if the new one cannot take its place, and deleted last.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to, name = jvm.org.apache.hadoop.fs.Path(path), f"{path.rstrip('/')}.{{}}-{uuid.uuid4().hex}"
    staged, aside = (jvm.org.apache.hadoop.fs.Path(name.format(x)) for x in ("staged", "aside"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to) and not overwrite:
        raise FileExistsError(path)
    try:
        df.write.parquet(staged.toString())
        check(spark.read.parquet(staged.toString()))
        there = fs.exists(to)
        if there and not fs.rename(to, aside):
            raise OSError(f"cannot move the old table at {path}")
        if not fs.rename(staged, to):
            if there:
                fs.rename(aside, to)
            raise OSError(f"cannot move the table to {path}")
        if there:
            fs.delete(aside, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)


def load_json(path: str, required: bool = True) -> dict[str, Any]:
    """A configuration document; a missing one is empty unless required."""
    if not required and not Path(path).is_file():
        return {}
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(path: str, value: Any) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n", encoding="utf-8")


def first_defined(*values: Any, default: Any = None) -> Any:
    return next((v for v in values if v is not None), default)
