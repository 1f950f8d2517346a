"""The test tables in the shapes the stages work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import clean, examples, inventory, split, weights
from corpusloom.operators.clean import CANONICAL_ORDER
from corpusloom.sources import files

COMMIT = "0123456789abcdef"
#: The prose of the test tables has no code in it, so the patterns are of words.
RULES = clean.CleaningRules(
    project="corpus",
    exclude_path_prefixes=("doc/",),
    exclude_exact_paths=("drivers/en/src3/43.c", "kernel/en/src5/45.c", "drivers/en/src3/123.h"),
    data_pattern=r"[0-9]{3,}",
    data_min_count=3,
    data_per_line=0.5,
    include_pattern=r" erea ",
    domain_patterns=(" the ", " der ", " les ", " la "),
    domain_threshold=5,
)
MARKER = "License"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of ``documents``: source and language make the directory, the id the name and suffix."""
    docs = files.spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    top = F.element_at(F.array(*[F.lit(x) for x in CANONICAL_ORDER]), F.pmod(F.substr("source", F.lit(4)).cast("int"), F.lit(len(CANONICAL_ORDER))) + 1)
    k = F.pmod(F.floor(F.col("doc_id") / 20), F.lit(10))
    ext = F.when(k == 0, ".cpp").when(k == 1, ".hpp").when(k <= 4, ".h").otherwise(".c")
    folder = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat("source", F.lit("/")))
    return docs.select(F.concat(top, F.lit("/"), "lang", F.lit("/"), folder, F.col("doc_id").cast("string"), ext).alias("path"), F.col("text").cast("binary").alias("content"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.inventory(raw_files(spark, sf_dir), COMMIT, MARKER)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.classified(source_files(spark, sf_dir), RULES)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaned(source_files(spark, sf_dir), RULES)


def included(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).filter("included")


def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_files(included(spark, sf_dir))


def example_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("path", "content", "sha256", "repository_commit", "split_group", "split", "language", "extension", "directory_tier", "cpp_relevance", "cpp_training_priority")
    return split_files(spark, sf_dir).select(*names)


def all_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.completion_examples(example_input(spark, sf_dir))


def unique_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.cross_split_dedup(all_examples(spark, sf_dir))


def train_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = unique_examples(spark, sf_dir).filter("split = 'train'")
    # files that are data-heavy never get here, so every C++ row has a priority that weighs
    return weights.reweighted(rows)


#: model, step, change of accuracy in points
MODELS = (("base", 0, 0), ("checkpoint-100", 100, 0), ("checkpoint-200", 200, -2), ("checkpoint-300", 300, 1), ("final", None, -1))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores of five models on every document: multiples of 2**-20, whose sums are exact in any order."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    models = F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).cast("int").alias("step"), F.lit(a).alias("adj")) for m, s, a in MODELS]))
    rows = docs.select("doc_id", "source", models)
    tokens = F.lit(8) + F.col("doc_id") % 121
    micro = tokens * (F.lit(400000) + (F.col("doc_id") * 13 + F.coalesce("step", F.lit(350))) % 97 * 10000)
    correct = F.expr("(8 + doc_id % 121) * (50 + (doc_id * 7) % 50 + adj) div 100")
    k = F.col("doc_id") % 4
    return rows.select(
        "model",
        "step",
        F.col("doc_id").cast("string").alias("evaluation_key"),
        F.col("source").alias("source_path"),
        F.when(k == 0, "high").when(k == 1, "medium").when(k == 2, "low").otherwise("unknown").alias("cpp_priority"),
        (micro.cast("double") / float(1 << 20)).alias("negative_log_likelihood"),
        tokens.cast("long").alias("scored_tokens"),
        correct.cast("long").alias("correct_tokens"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn as the generated text and the assistant's next one as the reference, both whole."""
    turns = _table(spark, sf_dir, "conversations")
    side = lambda role, shift, name: turns.filter(F.col("role") == role).groupBy("conv_id", (F.col("turn") - shift).alias("turn")).agg(F.min("text").alias(name))
    return side("user", 0, "generated_text").join(side("assistant", 1, "reference_text"), ["conv_id", "turn"])
