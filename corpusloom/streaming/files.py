"""Inventory and classification of files as they arrive.

The stages up to classification look at one file at a time, so they run unchanged on a stream. The
choice of a canonical copy needs all copies and stays a batch stage; a stream can only keep the copy that
came first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StringType, StructField, StructType, TimestampType

from corpusloom.operators.clean import CleaningRules, classified
from corpusloom.operators.inventory import inventory

ARRIVALS = StructType([StructField("path", StringType()), StructField("content", BinaryType()), StructField("arrived", TimestampType())])


def read_arrivals(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of (path, content, arrived)."""
    return spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def classify_stream(arrivals: DataFrame, commit: str, rules: CleaningRules, marker: str | None = None) -> DataFrame:
    rows = inventory(arrivals, commit, marker) if marker else inventory(arrivals, commit)
    return classified(rows, rules)


def first_copies(rows: DataFrame, within: str = "1 hour") -> DataFrame:
    """Files that no rule excludes and whose content did not come before, as far back as ``within``."""
    return rows.filter("exclusion_reason is null").withWatermark("arrived", within).dropDuplicatesWithinWatermark(["sha256"])
