"""Splitting by directory, balanced by size and by scarce files, with leakage checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import paths
from corpusloom.functions.ids import SEED, stable_order
from corpusloom.operators.inventory import counts_of, cpp_only

#: The splits.
SPLITS = ("train", "validation", "evaluation")


@dataclass(frozen=True)
class SplitRules:
    seed: int = SEED
    size: dict[str, float] = field(default_factory=lambda: {"train": 0.8, "validation": 0.1, "evaluation": 0.1})
    cpp: dict[str, float] = field(default_factory=lambda: {"train": 0.7, "validation": 0.15, "evaluation": 0.15})


def group_stats(files: DataFrame) -> DataFrame:
    """Bytes, C++ files and high-priority ones of each directory."""
    cpp = F.col("extension").isin(*paths.CPP_EXTENSIONS)
    return files.groupBy(paths.parent_group(F.col("path")).alias("split_group")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("bytes"),
        F.count_if(cpp).alias("cpp_count"),
        F.count_if(cpp & (F.col("cpp_training_priority") == "high")).alias("high_cpp_count"),
    )


def _place(rules: SplitRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: [0, 0, 0] for s in SPLITS}
        targets: dict[str, list[float]] = {}
        weights = (1.0, 2.0, 3.0)
        for b in batches:
            names, chosen = [], []
            for row in b.to_pylist():
                if not targets:
                    targets = {s: [row["all_bytes"] * rules.size[s], row["all_cpp"] * rules.cpp[s], row["all_high"] * rules.cpp[s]] for s in SPLITS}
                own = (row["bytes"], row["cpp_count"], row["high_cpp_count"])

                def score(s: str, own=own, row=row) -> tuple:
                    total = 0.0
                    for i, (weight, size) in enumerate(zip(weights, own, strict=True)):
                        if i == 0 or size > 0:
                            target = targets[s][i]
                            total += weight * (0.0 if target <= 0 else (target - held[s][i]) / target)
                    return total, row[f"tie_{s}"], s

                best = max(SPLITS, key=score)
                held[best] = [x + y for x, y in zip(held[best], own, strict=True)]
                names.append(row["split_group"])
                chosen.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(chosen, pa.string())], names=["split_group", "split"])

    return run


def assign_groups(stats: DataFrame, rules: SplitRules) -> DataFrame:
    """(split_group, split): directories in order of scarce files and size, each to the split with most room.

    Hashing and dealing into ranges of the order run in parallel. The running totals then make it one pass: a task
    reads range after range, one row per directory, in constant memory.
    """
    totals = stats.agg(F.sum("bytes").alias("all_bytes"), F.sum("cpp_count").alias("all_cpp"), F.sum("high_cpp_count").alias("all_high"))
    name = F.col("split_group")
    rows = stats.crossJoin(F.broadcast(totals)).withColumns({"tie": stable_order(name, seed=rules.seed), **{f"tie_{s}": stable_order(name, s, seed=rules.seed) for s in SPLITS}})
    rows = rows.orderBy(F.desc("high_cpp_count"), F.desc("cpp_count"), F.desc("bytes"), "tie", "split_group")
    return rows.coalesce(1).mapInArrow(_place(rules), "split_group string, split string")


def split_files(files: DataFrame, rules: SplitRules | None = None) -> DataFrame:
    """``split_files`` of included files: all of a directory go to one split."""
    rules = rules or SplitRules()
    assigned = assign_groups(group_stats(files), rules)
    return files.withColumn("split_group", paths.parent_group(F.col("path"))).join(assigned, "split_group")


def split_summary(files: DataFrame) -> DataFrame:
    """Per split: files, directories, bytes and their share in percent, lines, C++ files."""
    rows = files.groupBy("split").agg(
        F.count(F.lit(1)).alias("files"), F.count_distinct("split_group").alias("groups"), F.sum("size_bytes").alias("bytes"), F.sum("line_count").alias("lines"), F.count_if(F.col("extension").isin(*paths.CPP_EXTENSIONS)).alias("cpp_files")
    )
    everything = F.sum("bytes").over(W.partitionBy(F.lit(1)))  # of three rows
    return rows.withColumn("byte_percentage", F.lit(100.0) * F.col("bytes").cast("double") / everything.cast("double"))


def split_counts(files: DataFrame) -> DataFrame:
    """(split, dimension, key, n): files by extension, and C++ files by priority."""
    return counts_of(files, {"extension": F.col("extension"), "cpp_priority": cpp_only(F.col("cpp_training_priority"))}, "split")


def leaks(files: DataFrame) -> DataFrame:
    """(kind, key, n): paths that repeat, and directories and contents in several splits; empty if all is well. One pass over the files."""
    names = {"path": "path", "group": "split_group", "content": "sha256"}
    keys = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("key")) for kind, c in names.items()]))
    found = files.select("split", keys).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("split")).cast("long").alias("splits"))
    return found.select("kind", "key", F.when(F.col("kind") == "path", F.col("rows")).otherwise(F.col("splits")).alias("n")).filter("n > 1")
