"""Column functions against small literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import ids, paths, scores, text, tokens
from corpusloom.operators.sampling import even_places, evenly_capped


@pytest.fixture(scope="module")
def one(spark):
    """The value of a column over literals."""
    frame = spark.range(1)
    return lambda column: frame.select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(("value", "n"), [("", 0), ("a", 1), ("a\n", 1), ("a\nb", 2), ("a\rb", 1)])
def test_count_lines(one, value, n):
    assert one(text.count_lines(lit(value))) == n


def test_licence(one):
    assert one(text.licence(lit(" * SPDX-License-Identifier: Apache-2.0 */"))) == "Apache-2.0"
    assert one(text.licence(lit("x\n" * 50 + "SPDX-License-Identifier: MIT"))) is None
    assert one(text.licence(lit("x\n" * 49 + "SPDX-License-Identifier: MIT\ny"))) == "MIT"


@pytest.mark.parametrize(("path", "tier"), [("kernel/a.c", "core"), ("soc/a.c", "platform"), ("modules/a.c", "integration"), ("doc/a.c", "other"), ("a.c", "other")])
def test_directory_tier(one, path, tier):
    assert one(paths.directory_tier(lit(path))) == tier


def test_paths(one):
    assert one(paths.parent_group(lit("a/b/c.h"))) == "a/b"
    assert one(paths.parent_group(lit("c.h"))) == "(repository-root)"
    assert one(paths.top_level(lit("c.h"))) == "(repository-root)"
    assert one(paths.extension(lit("a.b/C.HPP"))) == ".hpp"
    assert one(paths.extension(lit("a.b/c"))) == ""
    assert one(paths.clean_source_path(lit(None).cast("string"), lit(".\\.github\\x"))) == "github/x"
    assert one(paths.resolved_language(lit(" C++ "), lit("x.c"))) == "cpp"


def test_normalize_source(one):
    assert one(text.normalize_source(lit("a \r\nb\t\n\n"))) == "a\nb\n"
    assert one(text.normalize_source(lit(" \n"))) == ""


@pytest.mark.parametrize(("n", "cuts"), [(4, []), (5, [1, 2, 4]), (42, [4, 20, 21, 26, 36])])
def test_candidate_cuts(one, n, cuts):
    assert one(text.candidate_cuts(lit(n), 4, 16, 16)) == cuts


@pytest.mark.parametrize(("n", "limit", "places"), [(20, 8, [0, 3, 5, 8, 11, 14, 16, 19]), (3, 8, [0, 1, 2]), (5, 1, [2])])
def test_even_cap(one, n, limit, places):
    items = F.sequence(lit(0), lit(n - 1))
    assert one(evenly_capped(items, limit, even_places(F.size(items), limit))) == places


def test_first_place_alone(one):
    assert one(even_places(lit(9), 1, single="first")) == [0]


def _ints(*x):
    return F.array(*map(lit, x)) if x else F.array().cast("array<int>")


def test_arrays(one):
    assert one(scores.common_prefix(_ints(1, 2, 3), _ints(1, 5))) == 1
    assert one(scores.common_prefix(_ints(1, 2), _ints(1, 2, 3))) == 2
    assert one(scores.edit_distance(_ints(1, 2, 3, 4), _ints(2, 3, 5))) == 2
    assert one(scores.edit_distance(_ints(1, 2), _ints(3))) == 2
    assert one(scores.edit_distance(_ints(), _ints(3, 4))) == 2
    assert one(tokens.without_padding(_ints(5, 6, 0, 7), 0, 9)) == [5, 6]
    assert one(tokens.without_padding(_ints(5, 6), 0, 9)) == [5, 6]
    row = one(tokens.training_row(_ints(1, 2), _ints(3), 9))
    assert (row.input_ids, row.labels, row.attention_mask) == ([1, 2, 3, 9], [-100, -100, 3, 9], [1, 1, 1, 1])
    assert one(tokens.with_end(_ints(3, 9), 9)) == [3, 9]
    assert one(tokens.keep_last(_ints(1, 2), 5)) == [1, 2]
    assert one(tokens.drop_overflow(_ints(1, 2, 3), _ints(4, 5), 4)) == [2, 3]


@pytest.mark.parametrize(("n", "bucket"), [(1, 16), (16, 16), (17, 32), (128, 128), (500, 128)])
def test_generation_bucket(one, n, bucket):
    assert one(tokens.generation_bucket(tokens.generation_budget(lit(n), 128), 128)) == bucket


def test_empty_generation(spark):
    row = spark.range(1).select(*scores.score_generation(_ints(), _ints(), lit(""), lit(""))).first()
    assert (row.token_edit_similarity, row.matching_prefix_ratio, row.exact_match) == (1.0, 0.0, True)


def test_lift(one):
    assert one(scores.percent_reduction(lit(0.0), lit(1.0))) == 0
    assert one(scores.percent_reduction(lit(2.0), lit(1.0))) == 50
    assert one(scores.percent(lit(None).cast("double"))) == "—"
    assert one(scores.points(lit(0.0123))) == "+1.23"


def test_fingerprint(one):
    import hashlib

    assert one(ids.fingerprint(lit("a"), lit("b"))) == hashlib.sha256(b"a\0b").hexdigest()
    assert one(ids.stable_order(lit("x"))) == hashlib.sha256(b"20260717:x").hexdigest()[:16]


def _py_normalize(t):
    out = "\n".join(x.rstrip(" \t") for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")).rstrip()
    return out + "\n" if out else ""


def _py_code(t):
    rows = [x.rstrip() for x in t.replace("\r\n", "\n").split("\n")]
    while rows and not rows[0]:
        rows.pop(0)
    while rows and not rows[-1]:
        rows.pop()
    return "\n".join(rows)


def _py_first(t):
    return next((x.strip() for x in t.splitlines() if x.strip()), "")


def test_text_rules_equal_python(spark):
    random.seed(11)
    alphabet = ["a", "b", " ", "\t", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1f", "\x85", " ", "\xa0", "é", "SPDX-License-Identifier:", "*/"]
    texts = ["".join(random.choices(alphabet, k=random.randrange(12))) for _ in range(1500)]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", text.normalize_source(t).alias("n"), text.normalize_code(t).alias("c"), text.first_substantive_line(t).alias("f"), text.lines(t).alias("l"), text.is_blank(t).alias("b"), text.licence(t).alias("s"))

    def licence(x):
        for line in x.splitlines()[:50]:
            if "SPDX-License-Identifier:" in line:
                return line.split("SPDX-License-Identifier:", 1)[1].replace("*/", "").strip(" \t#/*")
        return None

    for r in rows.collect():
        assert r.n == _py_normalize(r.t), repr(r.t)
        assert r.c == _py_code(r.t), repr(r.t)
        assert r.f == _py_first(r.t), repr(r.t)
        assert r.l == r.t.splitlines(keepends=True), repr(r.t)
        assert r.b == (not r.t.strip()), repr(r.t)
        assert r.s == licence(r.t), repr(r.t)


def test_edit_distance_beyond_the_letters(spark):
    """Items past 40,000 different ones are still told apart."""
    row = spark.range(1).select(scores.edit_distance(F.array(F.lit(45_000)), F.sequence(F.lit(1), F.lit(45_000))).alias("d")).first()
    assert row.d == 44_999
    row = spark.range(1).select(scores.edit_distance(F.concat(F.sequence(F.lit(1), F.lit(45_000)), F.array(F.lit(45_001))), F.array(F.lit(45_002))).alias("d")).first()
    assert row.d == 45_001
