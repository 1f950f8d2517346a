"""Columns derived from a text. Lines and white space follow the Unicode rules of Python's str."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space; Java's Unicode class leaves out the four separators.
SPACE = r"[\s\x1C-\x1F]"
#: A line with its terminator, or a last line without one.
LINE = r"[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])|[^\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]+"
#: The licence marker and the pattern of hexadecimal literals.
SPDX_MARKER = "SPDX-License-Identifier:"
HEX_LITERAL = r"\b0x[0-9a-fA-F]{2,}\b"


def decoded(content: Column) -> Column:
    """Bytes as text; malformed parts are replaced, a missing file is empty."""
    return F.coalesce(F.make_valid_utf8(content.cast("string")), F.lit(""))


def universal_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def lines(text: Column) -> Column:
    """Lines with their terminators."""
    return F.regexp_extract_all(text, F.lit(LINE), F.lit(0))


def bare(line: Column) -> Column:
    return F.regexp_replace(line, r"[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]+\z", "")


def count_lines(text: Column) -> Column:
    """Only "\\n" ends a line; a last line without one counts."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("long")


def licence(text: Column, marker: str = SPDX_MARKER) -> Column:
    """What follows the marker in the first of the first 50 lines that has it."""
    line = F.get(F.filter(F.slice(lines(text), 1, 50), lambda x: F.contains(x, F.lit(marker))), F.lit(0))
    found = F.replace(F.substr(bare(line), F.instr(line, marker) + len(marker)), F.lit("*/"), F.lit(""))
    return F.trim(found, F.lit(" \t#/*"))


def pattern_count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"(?U)\A{SPACE}+", ""), rf"(?U){SPACE}+\z", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^\s\x1C-\x1F]")


def normalize_source(text: Column) -> Column:
    """Unix line ends, no blanks before them, none at the end but one line end."""
    body = F.array_join(F.transform(F.split(universal_newlines(text), "\n"), lambda x: F.rtrim(x, F.lit(" \t"))), "\n")
    body = F.regexp_replace(body, rf"(?U){SPACE}+\z", "")
    return F.when(body == "", "").otherwise(F.concat(body, F.lit("\n")))


def normalize_code(text: Column) -> Column:
    """For comparing completions: line ends, blanks before them and blank lines around do not count."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.array_join(F.transform(F.split(unix, "\n"), lambda x: F.regexp_replace(x, rf"(?U){SPACE}+\z", "")), "\n")
    return F.regexp_replace(F.regexp_replace(body, r"\A\n+", ""), r"\n+\z", "")


def first_substantive_line(text: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(lines(text), strip), lambda x: x != ""), F.lit(0)), F.lit(""))


def candidate_cuts(count: Column, minimum: int, stride: int, completion_lines: int) -> Column:
    """Cut lines of a file of ``count`` lines: strided ones, the middle and one before the end; none up to the minimum."""
    strided = F.sequence(F.lit(minimum), F.greatest(count - 1, F.lit(minimum)), F.lit(stride))
    extra = F.array(F.greatest(F.lit(1), F.floor(count / 2).cast("int")), F.greatest(F.lit(1), count - completion_lines))
    cuts = F.array_sort(F.array_distinct(F.concat(strided, extra)))
    return F.when(count > minimum, F.filter(cuts, lambda x: x < count)).otherwise(F.array().cast("array<int>"))


def to_last_line(text: Column) -> Column:
    """Up to the last line end; empty if there is none."""
    return F.regexp_extract(text, r"(?s)\A(.*\n)", 1)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))
