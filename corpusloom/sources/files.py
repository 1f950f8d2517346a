"""Scans of file trees, checkouts and adapter folders."""

from __future__ import annotations

import subprocess
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.paths import supported
from corpusloom.sources.schemas import REPOSITORY


def relative(root: str):
    """Path below ``root`` of a file's URI."""
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    plain = F.regexp_replace(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), r"^[a-z0-9]+:/+", "/")
    return F.substr(plain, F.lit(len(base) + 2))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all files of supported extensions under ``root``, in any case of letters.

    The listing's filter keeps other files from being opened.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[cChH]*").load(root)
    return listed.select(relative(root).alias("path"), "content").filter(supported(F.col("path")) & ~F.col("path").rlike(r"(^|/)\.git/"))


def scan_names(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files under ``root``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(relative(root).alias("path"), "length")


def strict_text(content):
    """UTF-8 text of bytes; malformed bytes are an error."""
    return F.validate_utf8(content.cast("string"))


def checksums(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of the files that exist, null for the rest; paths may be of any file system that Spark knows."""
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs

    def whole(p: str) -> str | None:
        at = hadoop.Path(p)
        fs = at.getFileSystem(conf)
        return fs.makeQualified(at).toString() if fs.exists(at) and fs.getFileStatus(at).isFile() else None

    asked = [(p, whole(p)) for p in paths]
    rows = spark.createDataFrame(asked, "path string, at string")
    there = sorted({q for _, q in asked if q})
    if not there:
        return rows.select("path", F.lit(None).cast("string").alias("sha256"))
    found = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", r"^file:/+", "file:/").alias("at"), F.sha2("content", 256).alias("sha256"))
    return rows.withColumn("at", F.regexp_replace("at", r"^file:/+", "file:/")).join(found, "at", "left").select("path", "sha256")


def command(words: list[str], cwd: str | None = None) -> str:
    """Output of a program; a failure is an error that holds what it said."""
    run = subprocess.run(words, cwd=cwd, capture_output=True, text=True, check=False)
    if run.returncode:
        raise RuntimeError(f"{' '.join(words)} failed ({run.returncode}): {run.stderr.strip() or run.stdout.strip()}")
    return run.stdout.strip()


def check_checkout(target: str, url: str | None = None, commit: str | None = None) -> str:
    """The commit of a clean git checkout, which must come from ``url`` and be ``commit`` where these are given."""
    if not (Path(target) / ".git").exists():
        raise RuntimeError(f"{target} is no git checkout")
    if command(["git", "status", "--porcelain"], target):
        raise RuntimeError(f"{target} has changes")
    if url and command(["git", "remote", "get-url", "origin"], target) != url:
        raise RuntimeError(f"{target} comes from elsewhere")
    head = command(["git", "rev-parse", "HEAD"], target)
    if commit and head != commit:
        raise RuntimeError(f"{target} is at {head}, expected {commit}")
    return head


def fetch(spark: SparkSession, url: str, revision: str, target: str) -> DataFrame:
    """One revision of a repository, fetched to ``target`` or checked there; returns the ``repository`` row."""
    if Path(target).exists() and any(Path(target).iterdir()):
        check_checkout(target, url)
    else:
        Path(target).mkdir(parents=True, exist_ok=True)
        command(["git", "init", "-q"], target)
        command(["git", "remote", "add", "origin", url], target)
    command(["git", "fetch", "-q", "--depth", "1", "origin", revision], target)
    command(["git", "checkout", "-q", "--detach", "FETCH_HEAD"], target)
    head, date = command(["git", "rev-parse", "HEAD"], target), command(["git", "show", "-s", "--format=%cI", "HEAD"], target)
    return spark.createDataFrame([(url, revision, head, date, datetime.now(timezone.utc).isoformat(), target)], REPOSITORY)


def tracked(spark: SparkSession, target: str) -> DataFrame:
    """(path) of the files git tracks in a checkout."""
    names = command(["git", "ls-files", "-z"], target).split("\0")
    return spark.createDataFrame([(n,) for n in names if n], "path string")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read from fewer files than there are, as a small table in one row group is.

    A table of many files is left as it is, and nothing shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
