"""Queries over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import ids, paths, scores, text, tokens
from corpusloom.operators import benchmarks, clean, examples, inventory, metrics, sampling, scoring, selection, split, weights
from corpusloom.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _by(column: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: inventory.counts_by(views.source_files(spark, sf), column)


for _name, _column in (("extension", "extension"), ("language", "language"), ("top_level", "top_level_directory")):
    QUERIES[f"inventory_by_{_name}"] = _by(_column)


@query
def inventory_all_counts(spark, sf):
    return inventory.all_counts(views.source_files(spark, sf))


@query
def inventory_totals(spark, sf):
    return inventory.totals(views.source_files(spark, sf))


@query
def inventory_top_directories(spark, sf):
    return inventory.most_common(views.source_files(spark, sf), "top_level_directory", 3)


@query
def source_manifest(spark, sf):
    return views.source_files(spark, sf).drop("content", "spdx_license")


@query
def duplicate_hash_stats(spark, sf):
    return inventory.duplicate_stats(views.source_files(spark, sf))


@query
def largest_files_top10(spark, sf):
    return inventory.largest(views.source_files(spark, sf).select("path", "size_bytes", "sha256"))


@query
def spdx_licenses(spark, sf):
    return views.source_files(spark, sf).select("path", "spdx_license")


@query
def line_counts(spark, sf):
    return views.source_files(spark, sf).select("path", "line_count", F.size(text.lines(text.decoded(F.col("content")))).alias("lines_of_any_kind"))


@query
def path_functions(spark, sf):
    p = F.col("path")
    out = [paths.extension(p).alias("extension"), paths.parent_group(p).alias("split_group"), paths.depth(p).alias("depth"), paths.directory_tier(p).alias("directory_tier"), ids.stable_order(p).alias("stable"), paths.clean_source_path(F.concat(F.lit("./."), F.replace(p, F.lit("/"), F.lit("\\")))).alias("cleaned"), paths.resolved_language(F.lit(None).cast("string"), p).alias("resolved_language")]
    return views.raw_files(spark, sf).select("path", *out)


@query
def clean_manifest(spark, sf):
    return views.cleaned(spark, sf).select("path", "included", "exclusion_reason", "duplicate_of", "directory_tier", "hex_literal_count", "hex_literals_per_line", "cpp_relevance", "cpp_training_priority")


@query
def exclusions_by_reason(spark, sf):
    return clean.exclusions(views.cleaned(spark, sf))


@query
def clean_totals(spark, sf):
    return clean.totals(views.cleaned(spark, sf))


@query
def clean_by_tier(spark, sf):
    return clean.by_tier(views.cleaned(spark, sf))


@query
def clean_cpp_priority(spark, sf):
    return clean.by_cpp_priority(views.cleaned(spark, sf))


@query
def split_group_stats(spark, sf):
    return split.group_stats(views.included(spark, sf))


@query
def split_assignment(spark, sf):
    return split.assign_groups(split.group_stats(views.included(spark, sf)), split.SplitRules())


@query
def split_manifest(spark, sf):
    return views.split_files(spark, sf).select("path", "sha256", "split_group", "split")


@query
def split_summary(spark, sf):
    return split.split_summary(views.split_files(spark, sf))


@query
def split_counts(spark, sf):
    return split.split_counts(views.split_files(spark, sf))


@query
def split_leakage_audit(spark, sf):
    return split.leaks(views.split_files(spark, sf))


@query
def normalized_text_lengths(spark, sf):
    body = text.normalize_source(text.decoded(F.col("content")))
    return views.raw_files(spark, sf).select("path", F.length(body).alias("characters"), F.sha2(body, 256).alias("sha256"))


@query
def candidate_cuts(spark, sf):
    rules = examples.ExampleRules()
    count = F.size(text.lines(text.normalize_source(text.decoded(F.col("content")))))
    return views.raw_files(spark, sf).select("path", F.explode(text.candidate_cuts(count, rules.minimum_cut, rules.stride, rules.completion_lines)).alias("cut_line"))


EXAMPLE_COLUMNS = ("id", "source_path", "split", "cut_line", "prompt_tokens", "completion_tokens", "total_tokens", "training_repeat", "fingerprint")


@query
def completion_examples(spark, sf):
    return views.all_examples(spark, sf).select(*EXAMPLE_COLUMNS)


def _described(spark, sf):
    """Examples without their texts, kept: ``claim`` reads them twice."""
    return views.all_examples(spark, sf).drop("prompt", "completion").persist()


@query
def cross_split_dedup(spark, sf):
    return examples.claim(_described(spark, sf)).select("id", "fingerprint", "split", "claimed")


@query
def example_summary(spark, sf):
    return examples.example_summary(examples.claim(_described(spark, sf)))


@query
def example_counts(spark, sf):
    return examples.example_counts(views.unique_examples(spark, sf))


@query
def fingerprint_audit(spark, sf):
    return examples.fingerprint_audit(views.unique_examples(spark, sf))


@query
def files_without_examples(spark, sf):
    return examples.files_without_examples(views.split_files(spark, sf).select("path", "split"), views.unique_examples(spark, sf))


@query
def evenly_capped_examples(spark, sf):
    """The cap on its own: 4 of the lines of each text."""
    lines = text.lines(text.decoded(F.col("content")))
    rows = views.raw_files(spark, sf).withColumn("items", F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>")))
    return rows.select("path", F.explode(sampling.evenly_capped(F.col("items"), 4, sampling.even_places(F.size("items"), 4))).alias("line"))


def _held_out(spark, sf):
    return benchmarks.trimmed(views.unique_examples(spark, sf).filter("split <> 'train'"))


BENCHMARK_COLUMNS = ("id", "original_id", "source_path", "cut_line", "completion_tokens", "total_tokens", "fingerprint")


@query
def trimmed_examples(spark, sf):
    return _held_out(spark, sf).select(*BENCHMARK_COLUMNS)


@query
def source_representatives(spark, sf):
    return benchmarks.representatives(_held_out(spark, sf)).select(*BENCHMARK_COLUMNS)


@query
def general_benchmark(spark, sf):
    return benchmarks.general_benchmark(benchmarks.representatives(_held_out(spark, sf))).select("id", "extension", "position")


@query
def cpp_benchmark(spark, sf):
    return benchmarks.cpp_benchmark(_held_out(spark, sf)).select(*BENCHMARK_COLUMNS)


@query
def benchmark_summary(spark, sf):
    return benchmarks.benchmark_summary(_held_out(spark, sf))


@query
def benchmark_counts(spark, sf):
    return benchmarks.benchmark_counts(_held_out(spark, sf))


def _benchmark(spark, sf):
    rows = benchmarks.general_benchmark(benchmarks.representatives(_held_out(spark, sf)))
    return sampling.evaluation_keys(rows, "general", ["source_path", "cut_line"])


@query
def evaluation_keys(spark, sf):
    return _benchmark(spark, sf).select("id", "evaluation_key", "benchmark_index")


def _prepared(spark, sf):
    """Ids are the tokens' lengths, which any engine can tell."""
    lengths = lambda c: F.transform(tokens.tokenize(F.col(c)), lambda t: F.length(t))
    rows = _benchmark(spark, sf).select("evaluation_key", lengths("prompt").alias("p"), lengths("completion").alias("c"))
    return scoring.prepared(rows, "p", "c", WINDOW)


def length_scorer(name: str = "base") -> scoring.Scorer:
    """Stands for a model: the longer the tokens the less likely; even lengths are foreseen."""
    step = int(name.rsplit("-", 1)[1]) if "-" in name else 0
    return lambda pairs: [(sum(c) * (1024 + step) / 16384, sum(x % 2 == 0 for x in c)) for _, c in pairs]


def echo_generator() -> scoring.Generator:
    """Stands for a model: the prompt, backwards."""
    return lambda prompts, most: [p[::-1][:most] for p in prompts]


@query
def teacher_scores(spark, sf):
    return scoring.teacher_scores(_prepared(spark, sf), length_scorer)


@query
def generated_replies(spark, sf):
    rows = scoring.generations(_prepared(spark, sf), echo_generator, 32)
    same = scores.common_prefix(F.col("generated_ids"), F.col("reference_ids"))
    return rows.select("evaluation_key", "generation_budget", "reference_was_truncated", F.size("generated_ids").alias("generated_tokens"), F.aggregate("generated_ids", F.lit(0), lambda a, x: a + x).alias("characters"), same.alias("matching_prefix_tokens"))


@query
def adapter_scores(spark, sf):
    adapters = spark.createDataFrame([(m,) for m, s, _ in views.MODELS if s is not None], "name string")
    return metrics.micro(scoring.adapter_scores(_prepared(spark, sf), adapters, length_scorer, 2), "model").drop("perplexity")


@query
def benchmark_preview(spark, sf):
    return benchmarks.preview(benchmarks.cpp_benchmark(_held_out(spark, sf))).select("id", "source_path", "cut_line", "prompt_tail")


@query
def reweight_groups(spark, sf):
    return weights.weight_counts(views.train_examples(spark, sf))


@query
def effective_share(spark, sf):
    return weights.effective_share(views.train_examples(spark, sf))


@query
def expanded_repeats(spark, sf):
    return sampling.expanded(views.train_examples(spark, sf).select("id", "training_repeat")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


#: Fixed value: the reference's maximum length of a sequence.
WINDOW = 1024


def _tokenized(spark, sf):
    """Prompts and completions as ids in a window of 1024."""
    rows = views.unique_examples(spark, sf).select("id", *[tokens.token_ids(tokens.tokenize(F.col(c))).alias(c) for c in ("prompt", "completion")])
    rows = rows.withColumn("prompt", tokens.drop_overflow(F.col("prompt"), F.col("completion"), WINDOW))
    return rows.select("id", F.inline(F.array(tokens.training_row(F.col("prompt"), F.col("completion"), 0))))


@query
def tokenized_sequences(spark, sf):
    """Lengths and label masks; ids stand for words by a hash of this engine, so they are counted."""
    return _tokenized(spark, sf).select("id", F.size("input_ids").alias("tokens"), F.size(F.filter("labels", lambda x: x == tokens.IGNORED)).alias("masked"), F.size("attention_mask").alias("attended"))


@query
def tokenized_stats(spark, sf):
    return metrics.tokenized_stats(_tokenized(spark, sf))


@query
def first_batch_tokens(spark, sf):
    return metrics.first_batch_tokens(_tokenized(spark, sf), ["id"], 10)


@query
def roundtrip_check(spark, sf):
    body = text.decoded(F.col("content"))
    return views.raw_files(spark, sf).agg(F.count_if(tokens.detokenize(tokens.tokenize(body)) != body).alias("mismatches"), F.sum(F.size(tokens.tokenize(body))).alias("tokens"))


@query
def generation_scores(spark, sf):
    rows = views.replies(spark, sf)
    rows = rows.withColumns({"g": tokens.tokenize(F.col("generated_text")), "r": tokens.tokenize(F.col("reference_text"))})
    return rows.select("conv_id", "turn", *scores.score_generation(F.col("g"), F.col("r"), F.col("generated_text"), F.col("reference_text")))


@query
def macro_generation_metrics(spark, sf):
    """Rounded to 9 digits, since a sum of doubles depends on the order of rows."""
    rows = metrics.macro(generation_scores(spark, sf))
    return rows.withColumns({c: F.round(F.col(c), 9) for c in ("matching_prefix_ratio", "token_edit_similarity")})


@query
def generation_lift(spark, sf):
    """From replies to the references themselves."""
    rows = views.replies(spark, sf)
    perfect = rows.select(*scores.score_generation(*[tokens.tokenize(F.col("reference_text"))] * 2, *[F.col("reference_text")] * 2))
    lift = metrics.generation_lift(metrics.macro(generation_scores(spark, sf)), metrics.macro(perfect))
    return lift.select(*[F.round(f"{c}_delta", 9).alias(f"{c}_delta") for c in metrics.MACRO])


@query
def generation_budgets(spark, sf):
    n = F.size(tokens.tokenize(F.col("completion")))
    budget = tokens.generation_budget(n, 128)
    return views.unique_examples(spark, sf).select("id", budget.alias("budget"), tokens.generation_bucket(budget, 128).alias("bucket"))


@query
def example_metrics(spark, sf):
    return metrics.example_metrics(views.scores(spark, sf)).select("model", "evaluation_key", "mean_negative_log_likelihood", "token_accuracy")


@query
def micro_metrics(spark, sf):
    return metrics.micro(views.scores(spark, sf), "model").drop("perplexity")


@query
def metric_groups(spark, sf):
    return metrics.metric_groups(views.scores(spark, sf), "model", "step").drop("perplexity")


def _two(spark, sf):
    rows = metrics.example_metrics(views.scores(spark, sf))
    return rows.filter("model = 'base'"), rows.filter("model = 'checkpoint-100'")


@query
def prediction_lift(spark, sf):
    return metrics.prediction_lift(*_two(spark, sf))


@query
def top_improvements(spark, sf):
    return metrics.extremes(metrics.prediction_lift(*_two(spark, sf))).select("kind", "evaluation_key", "mean_nll_reduction")


@query
def summary_lift(spark, sf):
    base, tuned = _two(spark, sf)
    out = metrics.summary_lift(metrics.micro(base), metrics.micro(tuned))
    return out.select("mean_nll_reduction", "mean_nll_reduction_percent", "token_accuracy_delta", "token_accuracy_delta_percentage_points")


@query
def group_lift(spark, sf):
    return metrics.group_lift(metrics.metric_groups(views.scores(spark, sf), "model", "step")).drop("perplexity_reduction")


@query
def worker_agreement(spark, sf):
    rows = metrics.micro(views.scores(spark, sf).filter("model = 'base'"), "model")
    return metrics.workers_agree(rows.withColumn("worker", F.explode(F.array(F.lit(0), F.lit(1)))))


def _ranked(spark, sf):
    return selection.ranked(metrics.metric_groups(views.scores(spark, sf), "model", "step"), 0.5)


@query
def guardrail_eligible(spark, sf):
    return _ranked(spark, sf).filter("eligible").select("model", "accuracy", "base_accuracy")


@query
def checkpoint_ranking(spark, sf):
    return _ranked(spark, sf).select("model", "step", "eligible", "rank", "high_nll", "all_nll")


@query
def checkpoint_selection(spark, sf):
    return selection.selected(_ranked(spark, sf))


@query
def smoke_selection(spark, sf):
    return selection.selected(_ranked(spark, sf), mode="smoke")


def _validation(spark, sf):
    """C++ files, half of which state a priority."""
    rows = views.included(spark, sf).filter(F.col("extension").isin(*paths.CPP_EXTENSIONS))
    return rows.select(F.concat(F.lit("./"), "path").alias("path"), "language", F.when(F.length("path") % 2 == 0, F.upper("cpp_training_priority")).alias("cpp_priority"))


@query
def manifest_priority_index(spark, sf):
    files = views.split_files(spark, sf).select("path", "cpp_training_priority", "split")
    return selection.manifest_index([files.filter("split = 'train'"), files.withColumn("cpp_training_priority", F.lit("low")).filter(F.length("path") % 3 == 0)])


@query
def priority_resolution(spark, sf):
    index = manifest_priority_index(spark, sf)
    return selection.with_priorities(_validation(spark, sf), index).select("resolved_path", "resolved_priority", "resolution")


@query
def validation_composition(spark, sf):
    return metrics.composition(selection.with_priorities(_validation(spark, sf), manifest_priority_index(spark, sf)))


@query
def priority_guards(spark, sf):
    return selection.priority_guards(selection.with_priorities(_validation(spark, sf), manifest_priority_index(spark, sf)))


def _adapter_files(spark, sf):
    """Two files per checkpoint folder, a folder per document; some lack one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    name = F.when(F.col("doc_id") == 0, "final_adapter").otherwise(F.concat(F.lit("checkpoint-"), F.col("doc_id").cast("string")))
    files = F.explode(F.array(*[F.lit(x) for x in selection.ADAPTER_FILES]))
    rows = docs.select("doc_id", name.alias("name"), files.alias("file")).filter("not (doc_id % 125 = 50 and file = 'adapter_config.json')")
    return rows.select(F.concat(F.lit("out/"), "name", F.lit("/"), "file").alias("path"))


@query
def adapter_shards(spark, sf):
    return selection.shards(selection.adapters(_adapter_files(spark, sf)), 3)


@query
def smoke_adapters(spark, sf):
    return selection.smoke_adapters(selection.adapters(_adapter_files(spark, sf))).select("name", "step")


@query
def smoke_sample(spark, sf):
    rows = views.included(spark, sf).select("path", (F.col("cpp_training_priority") == "high").alias("high"))
    return sampling.even_sample(rows, ["path"], 4, ["high"])


@query
def even_table_sample(spark, sf):
    """What a smoke run takes of a table."""
    return sampling.for_mode(views.included(spark, sf).select("path"), "smoke", ["path"], 12)


@query
def strided_sample(spark, sf):
    return sampling.strided(views.included(spark, sf).select("path"), ["path"], 30)


@query
def training_plan(spark, sf):
    rows = views.train_examples(spark, sf).agg(F.sum("training_repeat").cast("long").alias("rows"))
    return rows.select("rows", *scores.training_plan(F.col("rows"), 2, 5, 3, 1.0, 0.03))


@query
def normalized_replies(spark, sf):
    rows = views.replies(spark, sf)
    return rows.select("conv_id", "turn", F.sha2(text.normalize_code(F.col("generated_text")), 256).alias("normalized"), text.first_substantive_line(F.col("generated_text")).alias("first_line"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, deduplicate and count what is left and what went, by reason."""
    rows = clean.cleaned(views.source_files(spark, sf_dir), views.RULES)
    return rows.groupBy(F.coalesce("exclusion_reason", F.lit("included")).alias("outcome")).agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))


QUERIES["clean_outcomes"] = flagship
