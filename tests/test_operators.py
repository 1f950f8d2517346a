"""Stages on small tables, and the sources and sinks."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import clean, examples, inventory, metrics, sampling, selection, split, weights
from corpusloom.sources import files, jsonl, reports, schemas
from corpusloom.streaming import files as stream

RULES = clean.CleaningRules(project="corpus", exclude_path_prefixes=("scripts/",), exclude_exact_paths=("lib/known.h",), max_file_bytes=50)


def _files(spark, rows):
    return inventory.inventory(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary"), "c0")


def test_exclusion_order_and_canonical_copy(spark):
    same = b"int x;\n"
    rows = [("drivers/a.c", same), ("tests/x/y/a.c", same), ("tests/b.c", same), ("scripts/a.c", same), ("lib/e.c", b""), ("lib/n.c", b"a\0b"), ("lib/u.c", b"\xff\xfe"), ("lib/known.h", b"x" * 60), ("scripts/big.c", b"y" * 60), ("lib/big.c", b"z" * 51), ("lib/fit.c", b"z" * 50), ("lib/skip.txt", b"t")]
    out = {r.path: r for r in clean.cleaned(_files(spark, rows), RULES).collect()}
    reason = {p: r.exclusion_reason for p, r in out.items()}
    assert reason == {
        "drivers/a.c": "exact-duplicate", "tests/x/y/a.c": "exact-duplicate", "tests/b.c": None, "scripts/a.c": "excluded-path-prefix", "lib/e.c": "empty-file", "lib/n.c": "encoding-or-binary",
        "lib/u.c": "encoding-or-binary", "lib/known.h": "known-generated-or-vendored", "scripts/big.c": "excluded-path-prefix", "lib/big.c": "over-maximum-size", "lib/fit.c": None,
    }
    assert out["drivers/a.c"].duplicate_of == "tests/b.c"
    assert out["tests/b.c"].included and not out["lib/big.c"].included
    assert out["lib/u.c"].encoding_status == "utf-8-with-replacement"


def test_relevance(spark):
    heavy = b"0x12 0x34 0x56\n"
    rules = clean.CleaningRules(project="corpus", data_min_count=3)
    rows = [("samples/cpp/a.cpp", b"x"), ("lib/cpp/a.cpp", b"y"), ("tests/a.cpp", b"z"), ("misc/a.cpp", b"w"), ("misc/h.cpp", heavy), ("misc/i.cpp", b"#include <corpus/kernel.h>\n"), ("misc/p.hpp", b"K_A k_b DT_C CONFIG_D LOG_E"), ("misc/a.c", b"q")]
    out = {r.path: (r.cpp_relevance, r.cpp_training_priority) for r in clean.cleaned(_files(spark, rows), rules).collect()}
    assert out == {
        "samples/cpp/a.cpp": ("generic-or-third-party", "high"), "lib/cpp/a.cpp": ("generic-or-third-party", "medium"), "tests/a.cpp": ("generic-or-third-party", "medium"), "misc/a.cpp": ("generic-or-third-party", "low"),
        "misc/h.cpp": ("generated-or-data-heavy", "exclude"), "misc/i.cpp": ("direct-corpus", "high"), "misc/p.hpp": ("corpus-patterns", "high"), "misc/a.c": ("not-cpp", "not-cpp"),
    }


def test_split_keeps_directories_and_balances(spark):
    rows = [(f"lib/d{i}/f{j}.{'cpp' if i % 7 == 0 else 'c'}", f"{i} {j}".encode() * (1 + i % 5)) for i in range(60) for j in range(3)]
    found = split.split_files(clean.cleaned(_files(spark, rows), clean.CleaningRules(project="corpus")).filter("included")).cache()
    assert split.leaks(found).count() == 0
    shares = {r.split: r.bytes for r in split.split_summary(found).collect()}
    assert set(shares) == set(split.SPLITS)
    assert 0.7 < shares["train"] / sum(shares.values()) < 0.9
    again = split.split_files(clean.cleaned(_files(spark, rows[::-1]), clean.CleaningRules(project="corpus")).filter("included"))
    assert found.select("path", "split").exceptAll(again.select("path", "split")).count() == 0


def test_leaks_are_found(spark):
    rows = spark.createDataFrame([("a", "g", "h", "train"), ("a", "g", "i", "validation"), ("b", "k", "h", "validation")], "path string, split_group string, sha256 string, split string")
    assert sorted((r.kind, r.key, r.n) for r in split.leaks(rows).collect()) == [("content", "h", 2), ("group", "g", 2), ("path", "a", 2)]


def test_claim_prefers_train(spark):
    rows = spark.createDataFrame([("f", "evaluation", "a", 1), ("f", "train", "z", 9), ("f", "train", "z", 4), ("g", "evaluation", "a", 1)], "fingerprint string, split string, source_path string, cut_line int")
    kept = [(r.split, r.cut_line) for r in examples.cross_split_dedup(rows).orderBy("fingerprint").collect()]
    assert kept == [("train", 4), ("evaluation", 1)]
    assert examples.claim(rows).filter("not claimed").count() == 2


def test_repeats(spark):
    rows = spark.createDataFrame([("a", 0), ("b", None), ("c", 3)], "id string, training_repeat int")
    assert sorted(r.id for r in sampling.expanded(rows).collect()) == ["a", "b", "c", "c", "c"]
    assert sampling.expanded(rows.drop("training_repeat")).count() == 3
    assert sampling.shuffled(rows, 1, "id", limit=-1).count() == 3
    assert sampling.shuffled(rows, 1, "id", limit=2).count() == 2


def test_micro_average(spark):
    rows = spark.createDataFrame([("a", 1.0, 1, 1), ("b", 1.0, 3, 0)], "k string, negative_log_likelihood double, scored_tokens long, correct_tokens long")
    assert metrics.micro(rows).first().mean_negative_log_likelihood == 0.5
    empty = metrics.micro(rows.limit(0)).first()
    assert (empty.examples, empty.scored_tokens, empty.mean_negative_log_likelihood) == (0, 0, None)
    with_priority = rows.withColumn("cpp_priority", F.lit("high"))
    groups = {r.group: r.examples for r in metrics.metric_groups(with_priority).collect()}
    assert groups == {"all_cpp": 2, "high": 2, "medium": 0, "low": 0, "unknown": 0}


def _groups(spark, rows):
    cells = [(m, s, g, n, a) for m, s, acc, nll in rows for g, n, a in (("all_cpp", nll, acc), ("high", nll, acc))]
    return spark.createDataFrame(cells, "model string, step int, group string, mean_negative_log_likelihood double, token_accuracy double")


def test_selection(spark):
    rows = [("base", 0, 0.8, 1.0), ("A", 1, 0.794, 0.5), ("B", 2, 0.796, 0.9)]
    pick = lambda rows, **k: selection.selected(selection.ranked(_groups(spark, rows), 0.5), **k).first()
    assert pick(rows).recommended_checkpoint == "B"
    assert pick(rows, mode="smoke").recommended_checkpoint is None
    worse = pick([*rows[:2], ("B", 2, 0.796, 1.0)])
    assert worse.recommended_checkpoint is None and worse.best_measured_candidate == "B"


def test_weights_refuse_unknown_priorities(spark):
    rows = spark.createDataFrame([("cpp", "odd")], "language string, cpp_training_priority string")
    with pytest.raises(Exception, match="no such priority"):
        weights.reweighted(rows).collect()
    good = weights.reweighted(spark.createDataFrame([("cpp", "high"), ("c", "not-cpp")], "language string, cpp_training_priority string"))
    assert weights.checked(good, {"cpp_high": 1, "non_cpp": 1}).count() == 2
    with pytest.raises(ValueError, match="expected"):
        weights.checked(good, {"cpp_high": 2})


def test_priorities_from_nested_records(spark):
    rows = spark.createDataFrame([("a", None, ("HIGH ",)), ("b", "low", ("high",)), ("c", "odd", (None,))], "path string, priority string, metadata struct<cpp_priority:string>")
    index = spark.createDataFrame([("c", "medium")], "path string, priority string")
    out = {r.resolved_path: (r.resolved_priority, r.resolution) for r in selection.with_priorities(rows, index).collect()}
    assert out == {"a": ("high", "metadata.cpp_priority"), "b": ("low", "record.priority"), "c": ("medium", "manifest_join")}


def test_adapters(spark):
    names = ["checkpoint-20", "checkpoint-3", "checkpoint-x", "final_adapter"]
    paths = [f"o/{n}/{f}" for n in names for f in selection.ADAPTER_FILES] + ["o/checkpoint-9/adapter_config.json"]
    found = selection.adapters(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert [r.name for r in found.orderBy("position").collect()] == ["checkpoint-3", "checkpoint-20", "final_adapter"]


def test_tree_scan(spark, tmp_path):
    for name, data in {"lib/a.C": b"x", "b c+d.h": b"y", "lib/n.txt": b"z", ".git/x.c": b"g"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {r.path: bytes(r.content) for r in files.scan_tree(spark, str(tmp_path)).collect()} == {"lib/a.C": b"x", "b c+d.h": b"y"}
    sums = {r.path: r.sha256 for r in files.checksums(spark, [str(tmp_path / "lib/a.C"), "/none"]).collect()}
    assert sums["/none"] is None and len(sums[str(tmp_path / "lib/a.C")]) == 64


def test_fetch_and_guards(spark, tmp_path):
    source, target = tmp_path / "s", tmp_path / "t"
    source.mkdir()
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", *a], cwd=source, check=True, capture_output=True)
    git("init", "-q")
    (source / "a.c").write_text("int x;\n")
    git("add", ".")
    git("commit", "-qm", "one")
    row = files.fetch(spark, str(source), "HEAD", str(target)).first()
    assert files.check_checkout(str(target), str(source), row.resolved_commit) == row.resolved_commit
    assert [r.path for r in files.tracked(spark, str(target)).collect()] == ["a.c"]
    with pytest.raises(RuntimeError, match="expected"):
        files.check_checkout(str(target), commit="0" * 40)
    (target / "a.c").write_text("changed")
    with pytest.raises(RuntimeError, match="changes"):
        files.check_checkout(str(target))


def test_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", "é")], "path string, extra string")
    jsonl.write_jsonl(rows, str(tmp_path / "o"), order=["path"])
    lines = [x for p in sorted((tmp_path / "o").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"extra":"é","path":"a"}', '{"extra":null,"path":"b"}']
    assert jsonl.read_jsonl(spark, str(tmp_path / "o"), rows.schema).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"path":"x"}\n\nnot json\n')
    assert [r.line for r in jsonl.quarantine(spark, str(tmp_path / "bad.jsonl"), rows.schema).collect()] == ["not json"]
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), rows.schema).collect()


def test_checked_write(spark, tmp_path):
    def refuse(df):
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        jsonl.write_checked(spark.range(3), str(tmp_path / "t"), refuse)
    assert list(tmp_path.iterdir()) == []
    jsonl.write_checked(spark.range(3), str(tmp_path / "t"), lambda df: None)
    with pytest.raises(FileExistsError):
        jsonl.write_checked(spark.range(3), str(tmp_path / "t"), lambda df: None)
    jsonl.write_checked(spark.range(4), str(tmp_path / "t"), lambda df: None, overwrite=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_json_and_reports(spark, tmp_path):
    jsonl.write_json(str(tmp_path / "c" / "x.json"), {"b": 1})
    assert jsonl.load_json(str(tmp_path / "c" / "x.json")) == {"b": 1}
    assert jsonl.load_json(str(tmp_path / "none.json"), required=False) == {}
    assert json.loads((tmp_path / "c" / "x.json").read_text()) == {"b": 1}
    assert reports.markdown_table(spark.createDataFrame([("a|b", None)], "x string, y int"), right=("y",)) == "| x | y |\n|---|---:|\n| a\\|b | — |"
    assert len(schemas.EXAMPLES) == 19 and len(schemas.CLEANED_FILES) == 20


def test_stream(spark, tmp_path):
    rows = [("lib/a.c", bytearray(b"same"), "2024-01-01 00:00:00"), ("lib/b.c", bytearray(b"same"), "2024-01-01 00:01:00"), ("lib/c.c", bytearray(b""), "2024-01-01 00:02:00")]
    frame = spark.createDataFrame(rows, "path string, content binary, arrived string").withColumn("arrived", F.col("arrived").cast("timestamp"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = stream.first_copies(stream.classify_stream(stream.read_arrivals(spark, str(tmp_path / "in")), "c0", RULES)).select("path", "sha256")
    query = out.writeStream.format("memory").queryName("arrived_files").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("arrived_files").count() == 1


def test_views_keep_long_documents(spark):
    """Documents over 8,000 bytes, but under the reference's limit, are not left out for their size."""
    from corpusloom.plans import views

    rows = views.classified(spark, "/root/testdata/sf0.001").filter("size_bytes > 8000").select("size_bytes", "exclusion_reason").collect()
    assert rows and all(r.size_bytes <= 409_600 and r.exclusion_reason != "over-maximum-size" for r in rows)
