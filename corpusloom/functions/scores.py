"""Scores of completions and the lift of one model over another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import let
from corpusloom.functions.text import first_substantive_line, normalize_code


def common_prefix(left: Column, right: Column) -> Column:
    n = F.least(F.size(left), F.size(right))
    same = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: a == b)
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(n).cast("long")


def _edit_table(left: Column, right: Column) -> Column:
    """Levenshtein distance of two arrays, row by row of the usual table."""

    def row(above: Column, item: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            change = F.get(above, j) + F.when(F.get(right, j) == item, 0).otherwise(1)
            return F.concat(acc, F.array(F.least(change, F.get(above, j + 1) + 1, F.get(acc, j) + 1)))

        return F.aggregate(F.when(F.size(right) > 0, F.sequence(F.lit(0), F.size(right) - 1)).otherwise(F.array().cast("array<int>")), F.array(F.get(above, F.lit(0)) + 1), cell)

    return F.aggregate(left, F.sequence(F.lit(0), F.size(right)), row, lambda last: F.get(last, F.size(right)))


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two arrays.

    Each item is written as the letter of its place among both arrays' items, and the strings are compared.
    Where there are more than 40,000 different items letters run out, and the table is filled row by row.
    """
    first = 0x3400  # letters from here to the surrogates

    def compared(items: Column) -> Column:
        def letter(x: Column) -> Column:
            return F.lpad(F.hex(F.array_position(items, x) + first), 4, "0")

        word = lambda a: F.decode(F.unhex(F.array_join(F.transform(a, letter), "")), "UTF-16BE")
        return F.when(F.size(items) <= 40_000, F.levenshtein(word(left), word(right))).otherwise(_edit_table(left, right))

    return let(F.array_distinct(F.concat(left, right)), compared).cast("long")


def score_generation(ids: Column, reference_ids: Column, text: Column, reference: Column) -> list[Column]:
    distance = edit_distance(ids, reference_ids)
    longest = F.greatest(F.size(ids), F.size(reference_ids))
    prefix = common_prefix(ids, reference_ids)
    return [
        (text == reference).alias("exact_match"),
        (normalize_code(text) == normalize_code(reference)).alias("normalized_exact_match"),
        (first_substantive_line(text) == first_substantive_line(reference)).alias("first_line_exact_match"),
        prefix.alias("matching_prefix_tokens"),
        (prefix / F.greatest(F.size(reference_ids), F.lit(1)).cast("double")).alias("matching_prefix_ratio"),
        distance.alias("token_edit_distance"),
        F.when(longest == 0, 1.0).otherwise(F.lit(1.0) - distance / F.nullif(longest, F.lit(0)).cast("double")).alias("token_edit_similarity"),
        F.size(ids).cast("long").alias("generated_tokens"),
        F.size(reference_ids).cast("long").alias("reference_tokens"),
    ]


def percent_reduction(base: Column, tuned: Column) -> Column:
    """In percent; 0 for a base of 0."""
    return F.when(base == 0, 0.0).otherwise((base - tuned) / F.nullif(base, F.lit(0.0)) * 100.0)


def reduction(candidate: Column, base: Column) -> Column:
    """As a fraction; an undefined one is null."""
    return F.try_divide(base - candidate, base)


def percent(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("%+.2f%%", value * 100.0))


def points(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("%+.2f", value * 100.0))


def metric_line(name: Column, mean_nll: Column, perplexity: Column, accuracy: Column) -> Column:
    return F.format_string("%s: NLL=%.6f, PPL=%.4f, accuracy=%.2f%%", name, mean_nll, perplexity, accuracy * 100.0)


def report_round(digits: int):
    """Rounding for reports: of the exact binary value, halves to even, as Python's round does; on bounded aggregates."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if pd.isna(x) else round(x, digits))

    return rounded


def training_plan(rows: Column, per_device: int, devices: int, accumulation: int, epochs: float, warmup: float) -> list[Column]:
    """Micro-batches and optimizer steps of an epoch, steps of the run and of its warm-up."""
    micro = F.ceil(rows / (per_device * devices))
    steps = F.ceil(micro / accumulation)
    planned = F.greatest(F.lit(1), F.ceil(steps * F.lit(epochs)))
    warm = F.greatest(F.lit(1), F.rint(planned * F.lit(warmup))) if warmup > 0 else F.lit(0)
    return [micro.cast("long").alias("micro_batches"), steps.cast("long").alias("optimizer_steps"), planned.cast("long").alias("planned_steps"), warm.cast("long").alias("warmup_steps")]
