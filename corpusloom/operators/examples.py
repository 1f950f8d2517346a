"""Completion examples: files cut into prompts and continuations."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import ids, text, tokens
from corpusloom.functions.binding import let
from corpusloom.operators.inventory import counts_of, cpp_only
from corpusloom.operators.joins import first_per_key
from corpusloom.operators.sampling import even_places, evenly_capped


@dataclass(frozen=True)
class ExampleRules:
    context_lines: int = 96
    completion_lines: int = 16
    stride: int = 16
    minimum_cut: int = 4
    caps: dict[str, int] = field(default_factory=lambda: {"train": 8, "validation": 4, "evaluation": 4})
    repeats: dict[str, int] = field(default_factory=lambda: {"high": 20, "medium": 10, "low": 4, "not-cpp": 1})
    max_prompt: int = 896
    max_completion: int = 128
    min_prompt: int = 32
    min_completion: int = 8


def training_repeat(split: Column, priority: Column, repeats: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in repeats.items() for x in kv])
    return F.when(split == "train", F.coalesce(table[priority], F.lit(1))).otherwise(1)


def _capped(items: Column, split: Column, rules: ExampleRules) -> Column:
    """The evenly spaced examples of a file, by its split's limit."""
    out = F.slice(items, 1, 0)
    for name, limit in rules.caps.items():
        out = F.when(split == name, let(even_places(F.size(items), limit), lambda places, limit=limit: evenly_capped(items, limit, places))).otherwise(out)
    return out


def _measured(lines: Column) -> Column:
    """For each line how many tokens it adds to a text that goes on with it, and whether its first is one with the last of the line before."""
    kind = lambda c: F.when(c.rlike(r"\w"), 1).when(c.rlike(r"\s"), 2).otherwise(3)
    ends = F.transform(lines, lambda x: F.struct(F.size(tokens.tokenize(x)).alias("n"), kind(F.left(x, F.lit(1))).alias("first"), kind(F.right(x, F.lit(1))).alias("last")))

    def net(all_: Column) -> Column:
        joined = lambda x, i: F.when(i > 0, (F.get(all_, F.greatest(i - 1, F.lit(0)))["last"] == x["first"]).cast("int")).otherwise(0)
        return F.transform(all_, lambda x, i: F.struct((x["n"] - joined(x, i)).alias("net"), joined(x, i).alias("joined")))

    return let(ends, net)


def _window(lines: Column, measured: Column, start: Column, count: Column, limit: int, keep) -> Column:
    """struct(text, n) of ``count`` lines from ``start``, cut to ``limit`` tokens by ``keep`` if there are more.

    Lines were counted once, so only a window that is too long is taken apart again. Tokens that are kept are runs of one
    kind, so the text they make has just as many.
    """
    text_ = F.array_join(F.slice(lines, start + 1, count), "")
    part = F.slice(measured, start + 1, count)
    total = F.aggregate(part, F.lit(0), lambda acc, x: acc + x["net"]) + F.coalesce(F.get(part, F.lit(0))["joined"], F.lit(0))
    cut = lambda n: F.when(n <= limit, text_).otherwise(tokens.detokenize(keep(tokens.tokenize(text_), limit)))
    return let(total, lambda n: F.struct(cut(n).alias("text"), F.least(n, F.lit(limit)).alias("n")))


def file_examples(files: DataFrame, rules: ExampleRules) -> DataFrame:
    """(cut_line, prompt, completion, counts ...) of each file, capped per file before any row is made.

    ``files`` has path, content, split and what else is to stay. Windows, tokens, filters and the cap all
    work inside the file's own array, so nothing shuffles and only the kept examples become rows.
    """
    body = text.normalize_source(text.decoded(F.col("content")))

    def windows(lines: Column, measured: Column) -> Column:
        def example(cut: Column) -> Column:
            start = F.greatest(F.lit(0), cut - rules.context_lines)
            prompt = _window(lines, measured, start, cut - start, rules.max_prompt, tokens.keep_last)
            completion = _window(lines, measured, cut, F.lit(rules.completion_lines), rules.max_completion, tokens.keep_first)
            return F.struct(cut.alias("cut_line"), prompt.alias("p"), completion.alias("c"))

        cuts = text.candidate_cuts(F.size(lines), rules.minimum_cut, rules.stride, rules.completion_lines)
        return F.filter(F.transform(cuts, example), usable)

    def usable(x: Column) -> Column:
        return (x["p"]["n"] >= rules.min_prompt) & (x["c"]["n"] >= rules.min_completion) & ~text.is_blank(x["p"]["text"]) & ~text.is_blank(x["c"]["text"])

    all_ = let(text.lines(body), lambda lines: let(_measured(lines), lambda measured: windows(lines, measured)))
    rows = files.withColumn("__examples", let(all_, lambda items: _capped(items, F.col("split"), rules))).drop("content")
    kept = [c for c in rows.columns if c != "__examples"]
    rows = rows.select(*kept, F.inline("__examples"))
    parts = [F.col("p.text").alias("prompt"), F.col("c.text").alias("completion"), F.col("p.n").alias("prompt_tokens"), F.col("c.n").alias("completion_tokens")]
    return rows.select(*kept, "cut_line", *parts, (F.col("p.n") + F.col("c.n")).alias("total_tokens"))


def completion_examples(files: DataFrame, rules: ExampleRules | None = None) -> DataFrame:
    """``examples`` of split files with path, content, sha256, repository_commit and the columns that go along."""
    rules = rules or ExampleRules()
    rows = file_examples(files, rules).withColumnsRenamed({"path": "source_path", "sha256": "source_sha256", "repository_commit": "source_commit"})
    rows = rows.withColumn("fingerprint", ids.fingerprint(F.col("prompt"), F.col("completion")))
    rows = rows.withColumn("id", ids.short_id(F.col("source_commit"), F.col("source_path"), F.col("cut_line"), F.col("fingerprint")))
    return rows.withColumn("training_repeat", training_repeat(F.col("split"), F.col("cpp_training_priority"), rules.repeats))


def split_rank(split: Column) -> Column:
    return F.when(split == "train", 0).when(split == "validation", 1).otherwise(2)


def _place() -> Column:
    return F.struct(split_rank(F.col("split")).alias("rank"), F.col("source_path").alias("path"), F.col("cut_line").alias("cut"))


def claim(examples: DataFrame) -> DataFrame:
    """``examples`` with ``claimed``: whether it is the first of its fingerprint, in order of split, path and cut (which tell examples apart).

    The first places are aggregated before they shuffle and looked up, so a fingerprint that many share is dealt over many tasks.
    """
    return first_per_key(examples, "fingerprint", _place(), "__first").withColumn("claimed", F.col("__first") == _place()).drop("__first")


def cross_split_dedup(examples: DataFrame) -> DataFrame:
    """The first example of each fingerprint; tasks keep their own first ones before they shuffle."""
    order = W.partitionBy("fingerprint").orderBy(split_rank(F.col("split")), "source_path", "cut_line")
    return examples.withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")


def example_summary(claimed: DataFrame) -> DataFrame:
    """Per split: rows, files, tokens and their averages, effective rows and removed duplicates, of ``claim``'s rows."""
    own = F.col("claimed")
    number = lambda c: F.sum(F.when(own, F.col(c)).otherwise(0)).cast("long")
    average = lambda c: number(c).cast("double") / F.greatest(F.count_if(own), F.lit(1)).cast("double")
    return claimed.groupBy("split").agg(
        F.count_if(own).alias("examples"),
        F.count_distinct(F.when(own, F.col("source_path"))).alias("source_files"),
        F.count_if(~own).alias("duplicates_removed"),
        number("prompt_tokens").alias("prompt_tokens"),
        number("completion_tokens").alias("completion_tokens"),
        number("training_repeat").alias("effective_examples"),
        average("prompt_tokens").alias("average_prompt_tokens"),
        average("completion_tokens").alias("average_completion_tokens"),
    )


def example_counts(examples: DataFrame) -> DataFrame:
    """(split, dimension, key, n): examples by language, and those of C++ files by priority."""
    return counts_of(examples, {"language": F.col("language"), "cpp_priority": cpp_only(F.col("cpp_training_priority"))}, "split")


def fingerprint_audit(examples: DataFrame) -> DataFrame:
    """One row: examples, different fingerprints, and whether all differ."""
    return examples.agg(F.count(F.lit(1)).alias("examples"), F.count_distinct("fingerprint").alias("fingerprints")).withColumn("unique", F.col("examples") == F.col("fingerprints"))


def files_without_examples(files: DataFrame, examples: DataFrame) -> DataFrame:
    """Per split: files, and those that no example comes from."""
    has = examples.groupBy("source_path").agg(F.lit(True).alias("has")).withColumnRenamed("source_path", "path")
    return files.join(has, "path", "left").groupBy("split").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("has").isNull()).alias("without_examples"))
