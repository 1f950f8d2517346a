"""Where models are called: scores of given continuations, greedy continuations, and one model after another.

A model is what ``load`` returns; it is called once per task, in the Python worker, so nothing of it is sent about.
Rows are looked at in order of length, so that a batch holds rows of like length and little of it is padding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import tokens

#: Of batches of (prompt ids, continuation ids): the continuation's negative log-likelihood, and how many of its tokens come first by the model.
Scorer = Callable[[list[tuple[list[int], list[int]]]], list[tuple[float, int]]]
#: Of batches of prompts, and most new tokens: the ids that go on.
Generator = Callable[[list[list[int]], int], list[list[int]]]

SCORES = "evaluation_key string, negative_log_likelihood double, scored_tokens long, correct_tokens long"


def batched(rows: list, size: int) -> Iterator[list]:
    for s in range(0, len(rows), size):
        yield rows[s : s + size]


def length_ordered(rows: DataFrame, *first: str) -> DataFrame:
    """``rows`` (prompt_ids, completion_ids) ordered by length within each task, after the columns ``first``."""
    return rows.withColumn("__length", F.size("prompt_ids") + F.size("completion_ids")).sortWithinPartitions(*first, "__length").drop("__length")


def prepared(rows: DataFrame, prompt: str, completion: str, window: int) -> DataFrame:
    """``rows`` with prompt_ids and completion_ids from arrays of ids, the prompt cut to the window; an empty prompt or completion, or one that
    leaves no room for a prompt, is an error."""
    wrong = F.when(F.size(prompt) == 0, "empty prompt").when(F.size(completion) == 0, "empty completion").when(F.size(completion) >= window, "the completion is too long")
    error = F.raise_error(F.concat(wrong, F.lit(" in "), F.col("evaluation_key"))).cast("boolean")
    checked = rows.filter(F.when(wrong.isNotNull(), error).otherwise(True))
    return checked.withColumns({"prompt_ids": tokens.drop_overflow(F.col(prompt), F.col(completion), window), "completion_ids": F.col(completion)})


def _scored(names: list[str], pairs: list, model: Scorer, size: int) -> Iterator[tuple]:
    for part in batched(list(zip(names, pairs, strict=True)), size):
        for (name, pair), (nll, right) in zip(part, model([p for _, p in part]), strict=True):
            yield name, float(nll), len(pair[1]), int(right)


def _columns(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    values = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[n for n, _ in fields])


def teacher_scores(rows: DataFrame, load: Callable[[], Scorer], size: int = 16) -> DataFrame:
    """Rows of SCORES for ``rows`` (evaluation_key, prompt_ids, completion_ids), ``size`` examples at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or load()
            names, prompts, completions = (c.to_pylist() for c in b.columns)
            yield _columns(list(_scored(names, list(zip(prompts, completions, strict=True)), model, size)), SCORES)

    return length_ordered(rows.select("evaluation_key", "prompt_ids", "completion_ids")).mapInArrow(run, SCORES)


GENERATED = "evaluation_key string, generated_ids array<int>, reference_ids array<int>, generation_budget int, reference_was_truncated boolean"


def generations(rows: DataFrame, load: Callable[[], Generator], maximum: int = 128, eos: int = -1, pad: int = -1, size: int = 8) -> DataFrame:
    """Rows of GENERATED: continuations of at most as many tokens as the reference has, ``maximum`` at most, and that part of the reference.

    Examples of one budget bucket are generated together; what follows an end or padding token is dropped.
    """
    budget = tokens.generation_budget(F.size("completion_ids"), maximum)
    asked = rows.select("evaluation_key", "prompt_ids", "completion_ids", budget.alias("budget"), tokens.generation_bucket(budget, maximum).alias("bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or load()
            held: dict[int, list] = {}
            for row in b.to_pylist():
                held.setdefault(row["bucket"], []).append(row)
            out = []
            for bucket, some in held.items():
                for part in batched(some, size):
                    for row, ids in zip(part, model([r["prompt_ids"] for r in part], bucket), strict=True):
                        out.append((row["evaluation_key"], ids[: row["budget"]], row["completion_ids"][: row["budget"]], row["budget"], len(row["completion_ids"]) > row["budget"]))
            yield _columns(out, GENERATED)

    made = length_ordered(asked, "bucket").mapInArrow(run, GENERATED)
    return made.withColumn("generated_ids", tokens.without_padding(F.col("generated_ids"), eos, pad))


def adapter_scores(rows: DataFrame, adapters: DataFrame, load: Callable[[str], Scorer], shares: int = 1, size: int = 16) -> DataFrame:
    """(model, SCORES) of every example under each of a few adapters (name). A task holds one model at a time; ``shares`` tasks have part of an adapter's examples."""
    dealt = rows.select("evaluation_key", "prompt_ids", "completion_ids").crossJoin(F.broadcast(adapters.select(F.col("name").alias("model"))))  # a few names
    dealt = dealt.withColumn("__share", F.pmod(F.xxhash64("evaluation_key"), F.lit(shares))).repartition("model", "__share").drop("__share")
    schema = f"model string, {SCORES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, model = None, None
        for b in batches:
            names, prompts, completions, models = (c.to_pylist() for c in b.columns)
            pairs, out, at = list(zip(prompts, completions, strict=True)), [], 0
            while at < len(models):
                end = next((i for i in range(at, len(models)) if models[i] != models[at]), len(models))
                if models[at] != held:
                    held, model = models[at], load(models[at])
                out += [(held, *r) for r in _scored(names[at:end], pairs[at:end], model, size)]
                at = end
            yield _columns(out, schema)

    return length_ordered(dealt, "model").mapInArrow(run, schema)
