"""Cleaning: exclusion reasons, relevance and exact duplicates with a canonical copy."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths, text

#: Order in which directories provide the canonical copy of a content.
CANONICAL_ORDER = ("samples", "tests", "include", "drivers", "subsys", "kernel", "lib", "arch", "soc", "boards", "modules", "dts", "doc", "misc")
#: Identifiers typical of the domain's code.
DOMAIN_PATTERNS = (
    r"\bCONFIG_[A-Z0-9_]+\b",
    r"\bDT_[A-Z0-9_]+\b",
    r"\bDEVICE_[A-Z0-9_]+\b",
    r"\bK_[A-Z0-9_]+\b",
    r"\bk_[a-zA-Z0-9_]+\b",
    r"\bLOG_[A-Z0-9_]+\b",
    r"\bZTEST(?:_F)?\b",
    r"\bSYS_[A-Z0-9_]+\b",
)


#: Folders whose C++ files are of high or medium priority whatever is in them.
HIGH_PREFIXES = ("samples/cpp/",)
MEDIUM_PREFIXES = ("lib/cpp/", "tests/")


@dataclass(frozen=True)
class CleaningRules:
    """``project`` names the include directory of the corpus and its relevance categories."""

    project: str
    max_file_bytes: int = 409_600
    exclude_path_prefixes: tuple[str, ...] = ()
    exclude_exact_paths: tuple[str, ...] = ()
    data_pattern: str = text.HEX_LITERAL
    data_min_count: int = 200
    data_per_line: float = 1.0
    include_pattern: str | None = None
    domain_patterns: tuple[str, ...] = DOMAIN_PATTERNS
    domain_threshold: int = 5
    high_prefixes: tuple[str, ...] = HIGH_PREFIXES
    medium_prefixes: tuple[str, ...] = MEDIUM_PREFIXES
    canonical_order: tuple[str, ...] = CANONICAL_ORDER
    deduplicate: bool = True

    @property
    def include(self) -> str:
        name = re.escape(self.project)
        return self.include_pattern or rf'#\s*include\s*[<"](?:{name}/|{name}\.h[>"])'


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def relevance(rules: CleaningRules, path: Column, ext: Column, body: Column, data_heavy: Column) -> tuple[Column, Column]:
    """Category and training priority of C++ files; "not-cpp" for the rest."""
    signals = sum((text.pattern_count(body, p) for p in rules.domain_patterns), F.lit(0))
    direct, patterns = f"direct-{rules.project}", f"{rules.project}-patterns"
    cpp = ext.isin(*paths.CPP_EXTENSIONS)
    category = (
        F.when(~cpp, "not-cpp").when(data_heavy, "generated-or-data-heavy").when(text.pattern_count(body, rules.include) > 0, direct).when(signals >= rules.domain_threshold, patterns).otherwise("generic-or-third-party")
    )
    name = F.col("cpp_relevance")
    priority = (
        F.when(~cpp, "not-cpp")
        .when(data_heavy, "exclude")
        .when(_any([path.startswith(p) for p in rules.high_prefixes]), "high")
        .when(name.isin(direct, patterns), "high")
        .when(_any([path.startswith(p) for p in rules.medium_prefixes]), "medium")
        .otherwise("low")
    )
    return category, priority


def classified(files: DataFrame, rules: CleaningRules) -> DataFrame:
    """``files`` with the first reason for exclusion, and measures of the text."""
    path, body = F.col("path"), text.universal_newlines(text.decoded(F.col("content")))
    rows = files.withColumn("__body", body)
    body = F.col("__body")
    rows = rows.withColumn("hex_literal_count", text.pattern_count(body, rules.data_pattern).cast("long"))
    rows = rows.withColumn("hex_literals_per_line", F.col("hex_literal_count") / F.greatest("line_count", F.lit(1)).cast("double"))
    rows = rows.withColumn("__heavy", (F.col("hex_literal_count") >= rules.data_min_count) & (F.col("hex_literals_per_line") >= rules.data_per_line))
    reason = (
        F.when(~F.col("candidate"), F.when(F.col("size_bytes") == 0, "empty-file").otherwise("encoding-or-binary"))
        .when(_any([path.startswith(p) for p in rules.exclude_path_prefixes]), "excluded-path-prefix")
        .when(path.isin(*rules.exclude_exact_paths) if rules.exclude_exact_paths else F.lit(False), "known-generated-or-vendored")
        .when(F.col("size_bytes") > rules.max_file_bytes, "over-maximum-size")
        .when(F.col("__heavy"), "hex-data-heavy")
    )
    category, priority = relevance(rules, path, F.col("extension"), body, F.col("__heavy"))
    rows = rows.withColumns({"exclusion_reason": reason, "directory_tier": paths.directory_tier(path), "cpp_relevance": category})
    return rows.withColumn("cpp_training_priority", priority).drop("__body", "__heavy")


def canonical_key(rules: CleaningRules) -> Column:
    """Order of the copies of a content: directory, depth, path."""
    rank = F.lit(999)
    for i, name in reversed(list(enumerate(rules.canonical_order))):
        rank = F.when(paths.first_part(F.col("path")) == name, i).otherwise(rank)
    return F.struct(rank.alias("rank"), paths.depth(F.col("path")).alias("depth"), F.col("path").alias("path"))


def cleaned(files: DataFrame, rules: CleaningRules) -> DataFrame:
    """``cleaned_files``: of the files no rule excludes, copies of one content but the canonical one are excluded as well."""
    rows = classified(files, rules)
    if not rules.deduplicate:
        return rows.withColumns({"duplicate_of": F.lit(None).cast("string"), "included": F.col("exclusion_reason").isNull()})
    # excluded files take part under a null key, which no copy has
    rows = rows.withColumn("__key", F.when(F.col("exclusion_reason").isNull(), F.col("sha256")))
    keyed = rows.filter("__key is not null")
    best = keyed.groupBy("__key").agg(F.min(canonical_key(rules)).alias("__best"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    shadow = F.xxhash64("__key")
    out = rows.withColumn("__shadow", shadow).join(best.withColumn("__shadow", shadow), ["__key", "__shadow"], "left")
    copy = F.col("__best").isNotNull() & (F.col("path") != F.col("__best.path"))
    out = out.withColumns({"duplicate_of": F.when(copy, F.col("__best.path")), "exclusion_reason": F.when(copy, "exact-duplicate").otherwise(F.col("exclusion_reason"))})
    return out.withColumn("included", F.col("exclusion_reason").isNull()).drop("__key", "__shadow", "__best", "__n")


def exclusions(rows: DataFrame) -> DataFrame:
    """(exclusion_reason, n) of the files that are out."""
    return rows.filter("not included").groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    """One row: files kept and out, bytes and lines kept."""
    own = F.col("included")
    kept = lambda c: F.sum(F.when(own, F.col(c)).otherwise(0))
    return rows.agg(F.count_if(own).alias("files"), F.count_if(~own).alias("excluded"), kept("size_bytes").alias("bytes"), kept("line_count").alias("lines"))


def by_tier(rows: DataFrame) -> DataFrame:
    """(directory_tier, n, bytes) of the files kept."""
    return rows.filter("included").groupBy("directory_tier").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


def by_cpp_priority(rows: DataFrame) -> DataFrame:
    """(cpp_relevance, cpp_training_priority, n) of the C++ files kept."""
    return rows.filter(F.col("included") & F.col("extension").isin(*paths.CPP_EXTENSIONS)).groupBy("cpp_relevance", "cpp_training_priority").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["by_cpp_priority", "by_tier", "exclusions", "totals", "CANONICAL_ORDER", "DOMAIN_PATTERNS", "CleaningRules", "canonical_key", "classified", "cleaned", "relevance"]
