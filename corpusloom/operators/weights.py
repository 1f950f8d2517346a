"""Re-weighting of scarce classes by repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths

#: Repetitions by group.
REWEIGHT = {"cpp_high": 112, "cpp_medium": 16, "cpp_low": 4, "non_cpp": 1}


def weight_group(language: Column, priority: Column) -> Column:
    known = F.concat(F.lit("cpp_"), priority)
    wrong = F.raise_error(F.concat(F.lit("no such priority: "), F.coalesce(priority, F.lit("null"))))
    return F.when(~F.coalesce(language.isin(*paths.CPP_LANGUAGES), F.lit(False)), "non_cpp").when(priority.isin("high", "medium", "low"), known).otherwise(wrong.cast("string"))


def reweighted(examples: DataFrame, policy: dict[str, int] | None = None) -> DataFrame:
    """``examples`` with weight_group and training_repeat by the policy."""
    table = F.create_map(*[F.lit(x) for kv in (policy or REWEIGHT).items() for x in kv])
    rows = examples.withColumn("weight_group", weight_group(F.col("language"), F.col("cpp_training_priority")))
    return rows.withColumn("training_repeat", table[F.col("weight_group")])


def weight_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("weight_group").agg(F.count(F.lit(1)).alias("examples"), F.sum("training_repeat").cast("long").alias("effective"))


def effective_share(rows: DataFrame) -> DataFrame:
    """Rows before and after repetition, and the share of C++ in both."""
    cpp = F.col("weight_group") != "non_cpp"
    share = lambda part, whole: F.col(part).cast("double") / F.nullif(F.col(whole), F.lit(0)).cast("double")
    totals = rows.agg(F.count(F.lit(1)).alias("examples"), F.sum("training_repeat").cast("long").alias("effective"), F.count_if(cpp).alias("cpp"), F.sum(F.when(cpp, F.col("training_repeat")).otherwise(0)).cast("long").alias("effective_cpp"))
    return totals.withColumns({"share": share("cpp", "examples"), "effective_share": share("effective_cpp", "effective")})


def checked(rows: DataFrame, expected: dict[str, int] | None) -> DataFrame:
    """``rows``, unless the counts by group differ from those expected."""
    if expected is not None:
        found = {r["weight_group"]: r["examples"] for r in weight_counts(rows).collect()}  # four rows at most
        if found != expected:
            raise ValueError(f"group counts {found}, expected {expected}")
    return rows
