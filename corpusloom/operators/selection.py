"""Choosing a checkpoint: priorities, guardrail, ranking; adapters and their shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from corpusloom.functions.paths import clean_source_path

#: Keys and containers that may hold a priority, in order, and its values.
PRIORITY_KEYS = ("cpp_training_priority", "training_priority", "cpp_priority", "priority")
CONTAINERS = ("metadata", "source_metadata", "file_metadata")
PRIORITIES = ("high", "medium", "low")
ADAPTER_FILES = ("adapter_config.json", "adapter_model.safetensors")


def stated_priority(rows: DataFrame) -> Column:
    """struct(value, key) of the first valid priority of a row or of a struct in it; null without one."""
    found = []
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    for box in (None, *CONTAINERS):
        names = set(kinds) if box is None else set(kinds[box].names) if isinstance(kinds.get(box), StructType) else set()
        for key in PRIORITY_KEYS:
            if key in names:
                value = F.lower(F.trim(F.col(key if box is None else f"{box}.{key}").cast("string")))
                found.append(F.when(value.isin(*PRIORITIES), F.struct(value.alias("value"), F.lit(f"{box or 'record'}.{key}").alias("key"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<value:string,key:string>")


def source_path(rows: DataFrame) -> Column:
    names = [c for c in ("source_path", "source", "path", "relative_path") if c in rows.columns]
    return clean_source_path(*[F.col(c).cast("string") for c in names])


def manifest_index(manifests: list[DataFrame]) -> DataFrame:
    """(path, priority): of several manifests, in order, the first that states a priority for a path."""
    out = None
    for rank, m in enumerate(manifests):
        rows = m.select(source_path(m).alias("path"), stated_priority(m)["value"].alias("priority"), F.lit(rank).alias("rank")).filter("priority is not null and path <> 'unknown'")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("path").agg(F.min_by("priority", F.struct("rank", "priority")).alias("priority"))


def with_priorities(rows: DataFrame, index: DataFrame) -> DataFrame:
    """``rows`` with resolved_path, resolved_priority and resolution: where the priority comes from."""
    own = rows.withColumns({"__own": stated_priority(rows), "resolved_path": source_path(rows)})
    out = own.join(index.select(F.col("path").alias("resolved_path"), F.col("priority").alias("__found")), "resolved_path", "left")
    return out.withColumns(
        {
            "resolved_priority": F.coalesce("__own.value", "__found", F.lit("unknown")),
            "resolution": F.coalesce("__own.key", F.when(F.col("__found").isNotNull(), "manifest_join"), F.lit("unresolved")),
        }
    ).drop("__own", "__found")


def priority_guards(rows: DataFrame) -> DataFrame:
    """One row: whether any priority is known and any is high."""
    return rows.agg(F.coalesce(F.bool_or(F.col("resolved_priority") != "unknown"), F.lit(False)).alias("some_known"), F.coalesce(F.bool_or(F.col("resolved_priority") == "high"), F.lit(False)).alias("some_high"))


def adapters(files: DataFrame) -> DataFrame:
    """(name, step, path, position) of (path of a file): checkpoints with both files by step, the final adapter last."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    rows = files.filter(F.regexp_extract("path", r"([^/]+)$", 1).isin(*ADAPTER_FILES)).groupBy(folder.alias("path")).agg(F.count_distinct(F.regexp_extract("path", r"([^/]+)$", 1)).alias("n")).filter(F.col("n") == len(ADAPTER_FILES))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    step = F.regexp_extract(name, r"^checkpoint-(\d+)$", 1)
    rows = rows.select(name.alias("name"), F.when(step != "", step.cast("int")).alias("step"), "path").filter(F.col("step").isNotNull() | (F.col("name") == "final_adapter"))
    return rows.withColumn("position", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("step"), "path")) - 1)


def smoke_adapters(rows: DataFrame) -> DataFrame:
    """The first and the middle checkpoint and the final adapter, or the last checkpoint without one."""
    everything = W.partitionBy(F.lit(1))
    n, final = F.count("step").over(everything), F.count_if(F.col("name") == "final_adapter").over(everything)
    at = F.when(F.col("step").isNotNull(), F.row_number().over(everything.orderBy(F.asc_nulls_last("step"), "path")) - 1)
    keep = at.eqNullSafe(0) | at.eqNullSafe(F.floor(n / 2)) | (F.col("name") == "final_adapter") | ((final == 0) & at.eqNullSafe(n - 1))
    return rows.withColumn("__keep", keep).filter("__keep").drop("__keep")


def shards(rows: DataFrame, workers: int) -> DataFrame:
    """Round-robin over the workers in order of position."""
    return rows.withColumn("worker", F.pmod("position", F.lit(workers)))


def ranked(groups: DataFrame, drop_points: float, base: str = "base") -> DataFrame:
    """Candidates with eligibility and rank.

    ``groups``: metric_groups by model and step. Eligible: accuracy over all rows not more than ``drop_points`` points
    under the base model's. Rank: NLL of high priority, then of all, then step (none last).
    """
    wide = groups.groupBy("model", "step").agg(*[F.max(F.when(F.col("group") == g, F.col(c))).alias(a) for g, c, a in (("all_cpp", "token_accuracy", "accuracy"), ("high", "mean_negative_log_likelihood", "high_nll"), ("all_cpp", "mean_negative_log_likelihood", "all_nll"))])
    of = wide.filter(F.col("model") == base).select(F.col("accuracy").alias("base_accuracy"), F.col("high_nll").alias("base_high_nll"))
    rows = wide.filter(F.col("model") != base).crossJoin(F.broadcast(of))  # one row
    rows = rows.withColumn("eligible", F.col("accuracy") >= F.col("base_accuracy") - F.lit(drop_points / 100.0))
    order = W.partitionBy("eligible").orderBy("high_nll", "all_nll", F.asc_nulls_last("step"))
    return rows.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(order)))


def selected(candidates: DataFrame, mode: str = "full") -> DataFrame:
    """One row: the best candidate, the one recommended and the decision; a smoke run recommends none."""
    best = candidates.agg(F.min_by("model", "rank").alias("best"), F.min_by("high_nll", "rank").alias("nll"), F.max("base_high_nll").alias("base_nll"), F.count_if("eligible").alias("eligible"))
    better = F.coalesce(F.col("nll") < F.col("base_nll"), F.lit(False)) & F.lit(mode != "smoke")
    decision = F.when(better, "select_checkpoint").otherwise("smoke_check_only; run_full_sweep" if mode == "smoke" else "no_checkpoint_validated; revise_sampling_or_training")
    return best.select("eligible", F.col("best").alias("best_measured_candidate"), F.when(better, F.col("best")).alias("recommended_checkpoint"), better.alias("beats_base_on_primary_metric"), decision.alias("decision"))
