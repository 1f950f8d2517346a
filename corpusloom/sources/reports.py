"""Markdown reports of bounded aggregates. Numbers are rounded here only, as Python formats them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.functions.scores import percent, points


def markdown_table(df: DataFrame, right: tuple[str, ...] = ()) -> str:
    """A table of all rows of ``df``, which is to be an aggregate or a top-k."""
    rule = "|".join("---:" if c in right else "---" for c in df.columns)
    rows = ["| " + " | ".join("—" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.collect()]
    return "\n".join(["| " + " | ".join(df.columns) + " |", f"|{rule}|", *rows])


def lift_table(lift: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row per candidate: gains on high priority and on all rows, and eligibility."""
    side = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    wide = lift.groupBy("model", "step").agg(
        percent(side("high", "mean_nll_reduction")).alias("high NLL reduction"),
        points(side("high", "token_accuracy_delta")).alias("high accuracy change"),
        percent(side("all_cpp", "mean_nll_reduction")).alias("all NLL reduction"),
        points(side("all_cpp", "token_accuracy_delta")).alias("all accuracy change"),
    )
    known = ranked.select("model", F.when(F.col("eligible"), "yes").otherwise("no").alias("eligible"))
    return wide.join(known, "model").withColumn("step", F.coalesce(F.col("step").cast("string"), F.lit("final"))).orderBy("model")


def sweep_report(lift: DataFrame, ranked: DataFrame, decision: DataFrame) -> str:
    d = decision.first()
    chosen = f"Select `{d['recommended_checkpoint']}`." if d["recommended_checkpoint"] else f"No checkpoint is recommended; the best measured is `{d['best_measured_candidate'] or 'none'}`."
    return f"# Checkpoint sweep\n\n{markdown_table(lift_table(lift, ranked))}\n\n## Decision\n\n{d['decision']}: {chosen}\n"


#: Titles of the metrics in reports.
GENERATION_TITLES = {"exact_match": "Exact match", "normalized_exact_match": "Normalized exact match", "first_line_exact_match": "First-line exact match", "matching_prefix_ratio": "Matching-prefix ratio", "token_edit_similarity": "Token edit similarity"}


def _signed(value: float, unit: str) -> str:
    return f"{value:+.2f}{unit}"


def lift_section(name: str, examples: int, lift: Row, generation: Row | None = None) -> str:
    """The tables of one benchmark, of ``summary_lift``'s and, if there is one, ``generation_lift``'s only row."""
    nll, ppl, acc = "mean_negative_log_likelihood", "perplexity", "token_accuracy"
    rows = [
        ("Mean NLL", f"{lift[f'base_{nll}']:.6f}", f"{lift[f'tuned_{nll}']:.6f}", _signed(lift["mean_nll_reduction_percent"], "% reduction")),
        ("Perplexity", f"{lift[f'base_{ppl}']:.4f}", f"{lift[f'tuned_{ppl}']:.4f}", _signed(lift["perplexity_reduction_percent"], "% reduction")),
        ("Token accuracy", f"{100 * lift[f'base_{acc}']:.2f}%", f"{100 * lift[f'tuned_{acc}']:.2f}%", _signed(lift["token_accuracy_delta_percentage_points"], " points")),
    ]
    out = [f"### {name.upper()} benchmark ({examples} examples)", "", *_table(("Teacher-forced metric", "Base", "Tuned", "Lift"), rows)]
    if generation is not None:
        share = lambda side, m: f"{100 * generation[f'{side}_{m}']:.2f}%"
        rows = [(title, share("base", m), share("tuned", m), _signed(100 * generation[f"{m}_delta"], " points")) for m, title in GENERATION_TITLES.items()]
        out += ["", *_table(("Greedy-generation metric", "Base", "Tuned", "Delta"), rows)]
    return "\n".join(out)


def _table(head: tuple[str, ...], rows: list[tuple[str, ...]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(head), "|---|" + "---:|" * (len(head) - 1), *map(line, rows)]


def _block(text: str) -> str:
    return f"````\n{text.rstrip()}\n````"


def examples_section(title: str, rows: DataFrame) -> str:
    """Side-by-side texts of a few examples (source_path, prompt, reference_completion, base_text, tuned_text, token_edit_similarity_delta)."""
    out = [f"### {title}"]
    for k, r in enumerate(rows.collect(), 1):  # a top-k
        out += [f"#### {k}. `{r['source_path']}`", f"Token edit-similarity delta: **{100 * r['token_edit_similarity_delta']:+.2f} points**"]
        for name, text in (("Prompt tail", r["prompt"][-1200:]), ("Reference", r["reference_completion"]), ("Base continuation", r["base_text"]), ("Tuned continuation", r["tuned_text"])):
            out += [f"{name}:", _block(text)]
    return "\n\n".join(out) if len(out) > 1 else ""


def evaluation_report(mode: str, model: str, revision: str, adapter: str, sections: list[str], examples: list[str] = ()) -> str:
    """The report of an evaluation, of its benchmarks' sections and, if all were generated for, of side-by-side examples."""
    head = ["# Code-completion evaluation", f"Mode: **{mode}**", f"Base model: `{model}`, revision `{revision}`", f"Adapter: `{adapter}`", "## Quantitative results", *sections]
    shown = [x for x in examples if x]
    return "\n\n".join([*head, *(["## Side-by-side examples", *shown] if shown else [])]).rstrip() + "\n"


def composition_section(composition: DataFrame) -> str:
    """What a validation set consists of, of ``composition``'s rows."""
    held: dict[str, list[str]] = {}
    for r in composition.orderBy("dimension", F.desc("n"), "key").collect():  # a few counts
        held.setdefault(r["dimension"], []).append(f"{r['key']} {r['n']}")
    return "\n".join(["## Validation composition", "", *[f"- {name.replace('_', ' ')}: {', '.join(v)}" for name, v in held.items()]])
