"""Inventory of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import paths, text


def inventory(files: DataFrame, commit: str, marker: str = text.SPDX_MARKER) -> DataFrame:
    """``source_files`` of (path, content: binary), kept if the extension is supported; other columns stay."""
    raw, body = F.col("content"), text.decoded(F.col("content"))
    ext = paths.extension(F.col("path"))
    return files.filter(paths.supported(F.col("path")) & (F.octet_length("content") >= 0)).select(
        "*",
        ext.alias("extension"),
        paths.language(ext).alias("language"),
        paths.top_level(F.col("path")).alias("top_level_directory"),
        F.octet_length(raw).cast("long").alias("size_bytes"),
        text.count_lines(body).alias("line_count"),
        F.sha2(raw, 256).alias("sha256"),
        text.licence(body, marker).alias("spdx_license"),
        F.when(F.is_valid_utf8(raw.cast("string")), "utf-8").otherwise("utf-8-with-replacement").alias("encoding_status"),
        F.contains(raw, F.lit(bytearray(b"\0"))).alias("has_null_bytes"),
        ((F.octet_length(raw) > 0) & ~F.contains(raw, F.lit(bytearray(b"\0"))) & F.is_valid_utf8(raw.cast("string"))).alias("candidate"),
        F.lit(commit).alias("repository_commit"),
    )


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def counts_of(rows: DataFrame, dimensions: dict[str, Column], *by: str) -> DataFrame:
    """(``by``, dimension, key, n) of several columns in one pass; null keys are not counted."""
    pairs = F.inline(F.array(*[F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("key")) for name, value in dimensions.items()]))
    return rows.select(*by, pairs).filter("key is not null").groupBy(*by, "dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def cpp_only(value: Column) -> Column:
    return F.when(F.col("extension").isin(*paths.CPP_EXTENSIONS), value)


def all_counts(files: DataFrame) -> DataFrame:
    """(dimension, key, n) for extension, language and top-level directory in one pass."""
    return counts_of(files, {n: F.col(n) for n in ("extension", "language", "top_level_directory")})


def most_common(rows: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """(``column``, n, position): counts from the largest, ties by key; the first ``n`` of them if given."""
    counted = counts_by(rows, column).orderBy(F.desc("n"), column)
    found = counted.limit(n) if n is not None else counted
    return found.withColumn("position", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("n"), column)))


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.count_if("candidate").alias("candidates"), F.sum("size_bytes").alias("bytes"), F.sum("line_count").alias("lines"))


def duplicate_stats(files: DataFrame) -> DataFrame:
    """Number of contents held by several files, and of files beyond the first of each."""
    groups = counts_by(files, "sha256").filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_files"))


def largest(files: DataFrame, n: int = 10) -> DataFrame:
    return files.orderBy(F.desc("size_bytes"), "path").limit(n)
