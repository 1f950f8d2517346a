"""Token arrays: the built-in lossless tokenizer, windows, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"\w+|[^\w\s]+|\s+"
IGNORED = -100


def tokenize(text: Column) -> Column:
    """Runs of word characters, of white space and of the rest; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def detokenize(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def token_ids(tokens: Column, vocabulary: int = 1 << 30) -> Column:
    """Integers that stand for the tokens where no vocabulary is at hand."""
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(vocabulary)).cast("int"))


def model_tokenizer(load: Callable[[], Callable[[str], list[int]]]):
    """A vectorised encode function; ``load`` runs once per Python worker."""

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = load()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else run(t))

    return encode


def keep_last(ids: Column, n: int) -> Column:
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def keep_first(ids: Column, n: int) -> Column:
    return F.slice(ids, 1, n)


def drop_overflow(prompt: Column, completion: Column, window: int) -> Column:
    """The prompt without the leading tokens that do not fit in the window."""
    over = F.greatest(F.size(prompt) + F.size(completion) - window, F.lit(0))
    return F.slice(prompt, over + 1, F.greatest(F.size(prompt), F.lit(1)))


def with_end(ids: Column, eos) -> Column:
    end = F.lit(eos)
    last = F.get(ids, F.size(ids) - 1)
    return F.when(last.eqNullSafe(end), ids).otherwise(F.concat(ids, F.array(end)))


def training_row(prompt: Column, completion: Column, eos: int) -> Column:
    """input_ids, attention_mask and labels with the prompt masked."""
    answer = with_end(completion, eos)
    ids = F.concat(prompt, answer)
    return F.struct(
        ids.alias("input_ids"),
        F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
        F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer).alias("labels"),
    )


def without_padding(ids: Column, eos, pad) -> Column:
    """Up to the first end or padding token."""
    at = lambda x: F.nullif(F.array_position(ids, F.lit(x)), F.lit(0))
    return F.slice(ids, F.lit(1), F.coalesce(F.least(at(eos), at(pad)) - 1, F.size(ids)).cast("int"))


def generation_budget(reference: Column, maximum: int) -> Column:
    return F.least(F.lit(maximum), reference)


def generation_bucket(budget: Column, maximum: int) -> Column:
    return F.least(F.lit(maximum), F.greatest(F.lit(8), (F.ceil(budget / 16) * 16).cast("int")))
