"""Quality rules whose cutoffs come with a guarantee, in DataFrame operations only.

Every text gets a few counts. Each rule turns them into a rate; a text is rejected when the
rate passes the rule's cutoff for its stratum. Cutoffs are selected on labelled rows: for
each stratum, rule and cutoff of a fixed grid, an exact binomial test asks whether the
chance of rejecting a good text is at most ``limit``. Cutoffs are tested from lenient to
strict until the first failure (a fixed sequence, which needs no correction), each sequence
at level ``error`` divided by the number of strata times rules (Bonferroni). With
probability 1 - ``error`` no selected cutoff passes its limit anywhere. Among the cutoffs that
hold, the one with the best balance of bad and good rejections is taken; where none holds
or none helps the rule is off in that stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.llm.common import WORD_GAP, cut, let, skew_join, text_or_empty

#: rule: (rate of the counts, cutoffs from lenient to strict); a rate over the cutoff rejects.
RULES = {
    "symbols": ("n_symbols / n_words", (2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    "long_words": ("word_chars / n_words", (30.0, 20.0, 15.0, 12.0, 10.0)),
    "short_words": ("n_words / word_chars", (0.9, 0.7, 0.6, 0.5, 0.4)),
}
WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words covered by a window of WINDOW words that is found twice or more in the array.

    Windows are compared by a 64-bit hash of their words within one text.
    """

    def windows(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + F.lit(k))
        made = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
        return F.when(F.size(h) >= WINDOW, made).otherwise(F.array().cast("array<bigint>"))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(p, j)["h"] == x["h"], F.lit(False))
            twins = F.filter(p, lambda x, j: (F.when(j > 0, same(x, F.greatest(j - 1, F.lit(0)))).otherwise(F.lit(False))) | same(x, j + 1))
            return F.sort_array(F.transform(twins, lambda x: x["i"]))

        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total"))
        return F.aggregate(let(pairs, starts), zero, step, lambda acc: acc["total"])

    def total(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), total)


def text_counts(df: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """One row per row of ``df``: id, stratum, the counts, base_failed. A null text has no word."""
    text = text_or_empty(text_col)
    words = F.filter(F.split("__text", WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("__text"))
    out = out.select(
        "doc_id",
        "stratum",
        F.length(F.regexp_replace("__text", WORD_GAP, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    out = out.select("doc_id", "stratum", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def _rate(rule: str) -> Column:
    above, below = (F.col(x.strip()).cast("double") for x in RULES[rule][0].split("/"))
    return F.when(below > 0, above / below).otherwise(F.lit(0.0))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial(n, p), summed exactly in logarithms; 1 where k >= n * p."""
    first = n * F.lit(math.log1p(-p))
    odds = F.lit(math.log(p) - math.log1p(-p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["total"] * F.exp(acc["term"] - term) + 1.0).alias("total"))

    start = F.struct(first.alias("term"), F.lit(1.0).alias("total"))
    many = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda a: a["total"] * F.exp(a["term"]))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(many)


def tested_cutoffs(counts: DataFrame, labels: DataFrame, limit: float, error: float) -> DataFrame:
    """(stratum, rule, step, cutoff, good, good_rejected, bad, bad_rejected, level, tail, holds).

    The table is bounded by strata * rules * grid.
    """
    labelled = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = counts.filter("not base_failed").join(labelled, "doc_id")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), _rate(r).alias("rate"), F.array(*[F.lit(c) for c in RULES[r][1]]).alias("grid")) for r in RULES])
    rates = rows.select("stratum", "quality", F.inline(rules))
    # one row per text and rule: the number of cutoffs its rate passes, then counts from above
    passed = rates.select("stratum", "rule", "quality", F.size(F.filter("grid", lambda c: F.col("rate") <= c)).alias("safe"), F.size("grid").alias("size"))
    tally = passed.groupBy("stratum", "rule", "safe", "size").agg(F.count_if(F.col("quality") == 1).alias("g"), F.count_if(F.col("quality") == 0).alias("b"))
    every = tally.groupBy("stratum", "rule", "size").agg(F.sum("g").alias("good"), F.sum("b").alias("bad"), F.collect_list(F.struct("safe", "g", "b")).alias("cells"))
    steps = every.select("*", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("step"))
    # rates that are safe from fewer than `step` lenient cutoffs pass cutoff number `step`
    above = lambda f: F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + F.when(x["safe"] < F.col("step"), x[f]).otherwise(0))
    # cutoffs fall with the step, so a rate rejected by cutoff j is rejected by all later ones: safe = steps before its first rejection
    steps = steps.withColumns({"good_rejected": above("g"), "bad_rejected": above("b")})
    level = F.lit(error) / (F.lit(float(len(RULES))) * F.size(F.collect_set("stratum").over(W.partitionBy(F.lit(1)))))
    grid = F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r), F.array(*[F.lit(c) for c in RULES[r][1]]))]), F.col("rule"))
    steps = steps.select("stratum", "rule", "step", F.element_at(grid, F.col("step")).alias("cutoff"), "good", "good_rejected", "bad", "bad_rejected", level.alias("level"))
    steps = steps.withColumn("tail", binomial_tail(F.col("good_rejected"), F.col("good"), limit))
    order = W.partitionBy("stratum", "rule").orderBy("step")
    return steps.withColumn("holds", (F.col("good") > 0) & (F.max(F.when(F.col("tail") <= F.col("level"), 0).otherwise(1)).over(order) == 0))


def select_cutoffs(tested: DataFrame, cost: float) -> DataFrame:
    """One row per stratum with a map from rule to cutoff; ``cost`` weighs the share of good texts lost."""
    gain = F.expr(f"bad_rejected / greatest(bad, 1) - {cost} * good_rejected / greatest(good, 1)")
    best = tested.filter(F.col("holds") & (F.col("bad_rejected") > 0)).withColumn("gain", gain).filter("gain > 0")
    best = best.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", -F.col("step"))).alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))


def quality_verdicts(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", limit: float = 0.01, error: float = 0.05, cost: float = 20.0
) -> DataFrame:
    """One row per row of ``df``: the counts, base_failed, rejected_by (array of rules) and kept.

    ``labels`` has doc_id and quality (1 good, 0 bad, null ignored; of several the lowest
    counts). A null or empty text has no word and fails the base rules. Without
    labels every rule is off and the base rules decide. Null strata form one of their own.
    """
    counts = cut(text_counts(df, id_col, text_col, stratum_col))
    cutoffs = select_cutoffs(tested_cutoffs(counts, labels, limit, error), cost)
    rows = skew_join(counts, cutoffs, ["stratum"], "left")
    hits = F.array_compact(F.array(*[F.when(_rate(r) > F.element_at("cutoffs", F.lit(r)), F.lit(r)) for r in RULES]))
    rows = rows.withColumn("rejected_by", F.coalesce(F.when(F.col("cutoffs").isNotNull(), hits), F.array().cast("array<string>")))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("cutoffs")
