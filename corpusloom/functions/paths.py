"""Columns derived from a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "(repository-root)"
#: Extensions and the languages they stand for.
LANGUAGES = {".c": "c", ".cpp": "cpp", ".h": "c_header", ".hpp": "cpp_header"}
#: Directories of each tier; all others are "other".
TIERS = {
    "core": ("samples", "tests", "include", "drivers", "subsys", "kernel", "lib"),
    "platform": ("arch", "soc", "boards", "dts"),
    "integration": ("modules",),
}
CPP_EXTENSIONS = (".cpp", ".hpp")
CPP_LANGUAGES = ("cpp", "cpp_header")


def extension(path: Column) -> Column:
    """Lower-cased last suffix, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(ext: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for suffix, name in LANGUAGES.items():
        out = out.when(ext == suffix, name)
    return out


def supported(path: Column) -> Column:
    return extension(path).isin(*LANGUAGES)


def top_level(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(ROOT))


def first_part(path: Column) -> Column:
    """The first part of a path: for a file in the root its own name."""
    return F.substring_index(path, "/", 1)


def parent_group(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1), F.lit("")), F.lit(ROOT))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def directory_tier(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for tier, names in TIERS.items():
        out = out.when(first_part(path).isin(*names), tier)
    return out.otherwise("other")


def clean_source_path(*candidates: Column) -> Column:
    """First path given, with forward slashes and no leading dots or slashes (as characters, so ".github" becomes "github")."""
    return F.ltrim(F.replace(F.coalesce(*candidates, F.lit("unknown")), F.lit("\\"), F.lit("/")), F.lit("./"))


def resolved_language(value: Column, path: Column) -> Column:
    """A stated C++ language, else the one the suffix says, else null."""
    stated = F.replace(F.lower(F.trim(value)), F.lit("c++"), F.lit("cpp"))
    return F.when(stated.isin(*CPP_LANGUAGES), stated).when(extension(path) == ".cpp", "cpp").when(extension(path) == ".hpp", "cpp_header")
