"""Metrics of scored examples: micro and macro averages, groups, lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scores import percent_reduction, reduction
from corpusloom.functions.tokens import IGNORED
from corpusloom.operators.inventory import counts_of

#: Metric groups in report order.
GROUPS = ("all_cpp", "high", "medium", "low", "unknown")
MACRO = ("exact_match", "normalized_exact_match", "first_line_exact_match", "matching_prefix_ratio", "token_edit_similarity")


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.nullif(b, F.lit(0)).cast("double")


def example_metrics(scores: DataFrame) -> DataFrame:
    """``scores`` (negative_log_likelihood, scored_tokens, correct_tokens) with each row's mean, perplexity and accuracy."""
    mean = _ratio(F.col("negative_log_likelihood"), F.col("scored_tokens"))
    return scores.withColumns({"mean_negative_log_likelihood": mean, "perplexity": F.exp(mean), "token_accuracy": _ratio(F.col("correct_tokens"), F.col("scored_tokens"))})


def micro(scores: DataFrame, *by: str) -> DataFrame:
    """Token-weighted averages. Sums of NLL are of doubles: their last digits may depend on the order of rows."""
    sums = [
        F.count(F.lit(1)).alias("examples"),
        F.coalesce(F.sum("scored_tokens"), F.lit(0)).cast("long").alias("scored_tokens"),
        F.coalesce(F.sum("correct_tokens"), F.lit(0)).cast("long").alias("correct_tokens"),
        F.sum(F.col("negative_log_likelihood").cast("double")).alias("__nll"),
    ]
    rows = scores.groupBy(*by).agg(*sums) if by else scores.agg(*sums)
    mean = _ratio(F.col("__nll"), F.col("scored_tokens"))
    return rows.withColumns({"negative_log_likelihood": F.col("__nll"), "mean_negative_log_likelihood": mean, "perplexity": F.exp(mean), "token_accuracy": _ratio(F.col("correct_tokens"), F.col("scored_tokens"))}).drop("__nll")


def metric_groups(scores: DataFrame, *by: str) -> DataFrame:
    """Averages over all rows and over each priority; a priority without rows shows as an empty group."""
    spark = scores.sparkSession
    both = scores.select("*", F.explode(F.array(F.lit("all_cpp"), F.col("cpp_priority"))).alias("group"))
    names = spark.createDataFrame([(g,) for g in GROUPS], "group string")
    frame = scores.select(*by).distinct().crossJoin(F.broadcast(names)) if by else names
    found = micro(both, *by, "group").withColumnsRenamed({c: f"__{c}" for c in (*by, "group")})
    same = F.lit(True)
    for c in (*by, "group"):
        same = same & frame[c].eqNullSafe(found[f"__{c}"])
    out = frame.join(found, same, "left").drop(*[f"__{c}" for c in (*by, "group")])
    return out.fillna(0, ["examples", "scored_tokens", "correct_tokens"])


def macro(scores: DataFrame, *by: str) -> DataFrame:
    """Means over examples; flags count as 0 and 1."""
    means = [F.avg(F.col(c).cast("double")).alias(c) for c in MACRO]
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("examples"), *means) if by else scores.agg(F.count(F.lit(1)).alias("examples"), *means)


def prediction_lift(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Scores of two models on the same examples, and the second's lift; an example that one of them lacks is an error."""
    names = ("mean_negative_log_likelihood", "token_accuracy", "matching_prefix_ratio", "token_edit_similarity")
    held = [c for c in names if c in base.columns and c in tuned.columns]
    also = [c for c in ("source_path", "cpp_priority") if c in base.columns]
    left = base.select("evaluation_key", *also, *[F.col(c).alias(f"base_{c}") for c in held], F.lit(True).alias("__base"))
    right = tuned.select("evaluation_key", *[F.col(c).alias(f"tuned_{c}") for c in held], F.lit(True).alias("__tuned"))
    rows = left.join(right, "evaluation_key", "full")
    lacking = F.when(F.col("__base").isNull(), "base").when(F.col("__tuned").isNull(), "tuned")
    error = F.raise_error(F.concat(F.lit("no score of the "), lacking, F.lit(" model for "), F.coalesce(F.col("evaluation_key").cast("string"), F.lit("null"))))
    rows = rows.filter(F.when(lacking.isNotNull(), error.cast("boolean")).otherwise(True)).drop("__base", "__tuned")
    b, t = (lambda c: F.col(f"base_{c}")), (lambda c: F.col(f"tuned_{c}"))
    out = {"mean_nll_reduction": b(names[0]) - t(names[0]), "mean_nll_reduction_percent": percent_reduction(b(names[0]), t(names[0])), "token_accuracy_delta": t(names[1]) - b(names[1])}
    out |= {f"{c}_delta": t(c) - b(c) for c in held[2:]}
    return rows.withColumns(out)


def summary_lift(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Lift of one row of averages over another."""
    side = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in ("mean_negative_log_likelihood", "perplexity", "token_accuracy")])
    rows = side(base, "base").crossJoin(side(tuned, "tuned"))  # one row each
    b, t = (lambda c: F.col(f"base_{c}")), (lambda c: F.col(f"tuned_{c}"))
    nll, ppl, acc = "mean_negative_log_likelihood", "perplexity", "token_accuracy"
    return rows.withColumns(
        {
            "mean_nll_reduction": b(nll) - t(nll),
            "mean_nll_reduction_percent": percent_reduction(b(nll), t(nll)),
            "perplexity_reduction": b(ppl) - t(ppl),
            "perplexity_reduction_percent": percent_reduction(b(ppl), t(ppl)),
            "token_accuracy_delta": t(acc) - b(acc),
            "token_accuracy_delta_percentage_points": (t(acc) - b(acc)) * 100.0,
        }
    )


def generation_lift(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Changes from one row of macro averages to another."""
    side = lambda df, tag: df.select(*[F.col(c).alias(f"{tag}_{c}") for c in MACRO])
    rows = side(base, "base").crossJoin(side(tuned, "tuned"))  # one row each
    return rows.select("*", *[(F.col(f"tuned_{c}") - F.col(f"base_{c}")).alias(f"{c}_delta") for c in MACRO])


def composition(rows: DataFrame) -> DataFrame:
    """(dimension, key, n) of resolved validation rows: languages, priorities and where these come from; under "source_files" how many there are."""
    counts = counts_of(rows, {"language": F.coalesce("language", F.lit("none")), "cpp_priority": F.col("resolved_priority"), "priority_resolution": F.col("resolution")})
    files = rows.agg(F.count_distinct("resolved_path").alias("n")).select(F.lit("source_files").alias("dimension"), F.lit("all").alias("key"), "n")
    return counts.unionByName(files)


def group_lift(groups: DataFrame, base: str = "base") -> DataFrame:
    """Per model and group, fractions of improvement over the base model; null where either has no example."""
    cols = ("examples", "mean_negative_log_likelihood", "perplexity", "token_accuracy")
    of = groups.filter(F.col("model") == base).select("group", *[F.col(c).alias(f"base_{c}") for c in cols])
    rows = groups.filter(F.col("model") != base).join(F.broadcast(of), "group")  # five groups
    some = (F.col("examples") > 0) & (F.col("base_examples") > 0)
    return rows.select(
        "model",
        "step",
        "group",
        F.when(some, reduction(F.col("mean_negative_log_likelihood"), F.col("base_mean_negative_log_likelihood"))).alias("mean_nll_reduction"),
        F.when(some, reduction(F.col("perplexity"), F.col("base_perplexity"))).alias("perplexity_reduction"),
        F.when(some, F.col("token_accuracy") - F.col("base_token_accuracy")).alias("token_accuracy_delta"),
    )


def extremes(rows: DataFrame, best: int = 4, worst: int = 2) -> DataFrame:
    """The largest improvements and regressions of mean NLL, ties by key."""
    delta = F.col("mean_nll_reduction")
    up = rows.filter(delta > 0).orderBy(delta.desc(), "evaluation_key").limit(best).withColumn("kind", F.lit("improvement"))
    down = rows.filter(delta < 0).orderBy(delta.asc(), "evaluation_key").limit(worst).withColumn("kind", F.lit("regression"))
    return up.unionByName(down)


def similarity_extremes(rows: DataFrame, best: int = 4, worst: int = 2) -> tuple[DataFrame, DataFrame]:
    """The largest gains and losses of edit similarity, ties by key."""
    delta = F.col("token_edit_similarity_delta")
    return rows.filter(delta > 0).orderBy(delta.desc(), "evaluation_key").limit(best), rows.filter(delta < 0).orderBy(delta.asc(), "evaluation_key").limit(worst)


def workers_agree(bases: DataFrame, relative: float = 1e-5, absolute: float = 1e-6) -> DataFrame:
    """One row: whether all workers scored as many tokens and the same mean, within tolerance."""
    mean = F.col("mean_negative_log_likelihood")
    spread = F.max(mean) - F.min(mean)
    return bases.agg((F.count_distinct("scored_tokens") <= 1).alias("same_tokens"), (spread <= F.greatest(F.lit(relative) * F.max(F.abs(mean)), F.lit(absolute))).alias("same_mean"))


def tokenized_stats(tokenized: DataFrame) -> DataFrame:
    """One row: the longest sequence, the mean of supervised tokens, and whether ids, labels and mask of all rows are of one length."""
    kept = F.size(F.filter("labels", lambda x: x != IGNORED))
    same = (F.size("input_ids") == F.size("labels")) & (F.size("input_ids") == F.size("attention_mask"))
    return tokenized.agg(F.max(F.size("input_ids")).alias("longest"), F.avg(kept).alias("mean_supervised"), F.bool_and(same).alias("aligned"))


def first_batch_tokens(tokenized: DataFrame, order: list[str], size: int) -> DataFrame:
    """One row: masked and supervised tokens of the first ``size`` rows; none supervised is an error."""
    masked = F.size(F.filter("labels", lambda x: x == IGNORED))
    batch = tokenized.orderBy(*order).limit(size)
    found = batch.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(masked), F.lit(0)).cast("long").alias("masked_tokens"), F.coalesce(F.sum(F.size("labels") - masked), F.lit(0)).cast("long").alias("supervised_tokens"))
    none = F.raise_error(F.lit("the first batch has no supervised token")).cast("boolean")
    return found.filter(F.when(F.col("supervised_tokens") == 0, none).otherwise(True))
