"""Held-out benchmarks: line-aligned references, one example per source, quotas by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import ids, paths, text, tokens
from corpusloom.operators.inventory import counts_of, cpp_only

#: Size of the general benchmark, and the share of C files in what C++ leaves.
GENERAL_SIZE, C_SHARE = 512, 0.65
#: A readable preview holds one of these.
READABLE = ("return", "if (", "{", "}", ";")


def trimmed(examples: DataFrame, minimum_tokens: int = 8) -> DataFrame:
    """Examples whose reference ends with a line; those that are blank or too short then go."""
    rows = examples.withColumns({"original_id": F.col("id"), "completion": text.to_last_line(F.col("completion"))})
    rows = rows.withColumn("completion_tokens", F.size(tokens.tokenize(F.col("completion"))))
    rows = rows.filter((F.col("completion") != "") & (F.col("completion_tokens") >= minimum_tokens) & ~text.is_blank(F.col("completion")))
    rows = rows.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "fingerprint": ids.fingerprint(F.col("prompt"), F.col("completion"))})
    return rows.withColumn("id", ids.short_id("benchmark", F.col("original_id"), F.col("fingerprint")))


def representatives(rows: DataFrame) -> DataFrame:
    """One example per source: high priority first, then near 400 and 80 tokens."""
    order = F.struct(F.when(F.col("cpp_training_priority") == "high", 0).otherwise(1), F.abs(F.col("prompt_tokens") - 400), F.abs(F.col("completion_tokens") - 80), ids.stable_order(F.col("id")))
    best = rows.groupBy("source_path").agg(F.min_by(F.struct("*"), order).alias("best"))
    return best.select("best.*")


def _kind():
    ext = F.col("extension")
    return F.when(ext.isin(*paths.CPP_EXTENSIONS), "cpp").when(ext == ".c", "c").when(ext == ".h", "header")


def general_benchmark(reps: DataFrame, size: int = GENERAL_SIZE) -> DataFrame:
    """All C++, then C and headers by quota in stable order; ``position`` is the order of the whole.

    Of C and header files no more than ``size`` can be taken, so that many of each kind leave a task; C++ files, which are
    scarce, are a group each, so all are kept. What is then counted and ordered is the benchmark.
    """
    rows = reps.withColumns({"kind": _kind(), "stable": ids.stable_order(F.col("id"))}).filter("kind is not null")
    own = F.when(F.col("kind") == "cpp", F.col("id"))
    rows = rows.withColumn("__rank", F.row_number().over(W.partitionBy("kind", own).orderBy("stable", "id"))).filter(F.col("__rank") <= size)
    left = F.greatest(F.lit(size) - F.count_if(F.col("kind") == "cpp").over(W.partitionBy(F.lit(1))), F.lit(0))
    c = F.rint(left * C_SHARE).cast("int")
    quota = F.when(F.col("kind") == "c", c).when(F.col("kind") == "header", left - c)
    out = rows.withColumn("__quota", quota).filter("__quota is null or __rank <= __quota").drop("__rank", "__quota")
    return out.withColumn("position", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("stable", "id"))).drop("kind", "stable")


def cpp_benchmark(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("extension").isin(*paths.CPP_EXTENSIONS)).orderBy("source_path", "cut_line")


def benchmark_summary(rows: DataFrame) -> DataFrame:
    average = lambda c: (F.coalesce(F.sum(c), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).cast("double")
    return rows.agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("source_path").alias("source_files"), average("prompt_tokens").alias("average_prompt_tokens"), average("completion_tokens").alias("average_completion_tokens"))


def benchmark_counts(rows: DataFrame) -> DataFrame:
    """(dimension, key, n): examples by language, and those of C++ files by priority."""
    return counts_of(rows, {"language": F.col("language"), "cpp_priority": cpp_only(F.col("cpp_training_priority"))})


def preview(rows: DataFrame) -> DataFrame:
    """The most typical readable example, or of all if none is readable."""
    shown = F.lit(False)
    for token in READABLE:
        shown = shown | F.contains("completion", F.lit(token))
    readable = (F.col("cpp_training_priority") == "high") & ~F.contains("completion", F.lit("\\\n")) & shown
    order = [F.when(readable, 0).otherwise(1), F.abs(F.col("completion_tokens") - 70), F.abs(F.col("prompt_tokens") - 400), "source_path", "cut_line"]
    return rows.orderBy(*order).limit(1).withColumn("prompt_tail", text.tail(F.col("prompt"), 700))
