"""Settings, reports, samples, sinks and model calls."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scores, text, tokens
from corpusloom.operators import benchmarks, examples, inventory, metrics, runs, sampling, scoring, selection, split
from corpusloom.plans import queries
from corpusloom.sources import files, jsonl, reports

DATA = "/root/testdata/sf0.001"


def test_checks():
    runs.check_positive(a=1, b=2)
    runs.check_not_negative(a=0.0)
    for wrong in (lambda: runs.check_positive(a=1, b=0), lambda: runs.check_not_negative(drop=-0.1)):
        with pytest.raises(ValueError):
            wrong()
    assert runs.device_list(" 0, 2,") == [0, 2]
    for wrong in ("", "a", "1,1", "-1"):
        with pytest.raises(ValueError):
            runs.device_list(wrong)
    with pytest.raises(ValueError, match=r"\[5\]"):
        runs.device_list("0,5", available=2)
    runs.check_adapter({"base_model_name_or_path": "m"}, "m")
    runs.check_adapter({}, "m")
    with pytest.raises(ValueError, match="'o'"):
        runs.check_adapter({"base_model_name_or_path": "o"}, "m")


def test_settings(tmp_path):
    kept, dropped = runs.usable_settings({"a": 1, "b": 2}, ["a", "x"], ["x"])
    assert (kept, dropped) == ({"a": 1}, ["b"])
    with pytest.raises(TypeError, match="fp16"):
        runs.usable_settings({}, set(runs.ESSENTIAL) - {"fp16"})
    assert runs.memory_limits({"0": "1", "cpu": "2"}) == {0: "1", "cpu": "2"} and runs.memory_limits(None) is None
    with pytest.raises(ValueError):
        runs.memory_limits([1])
    assert [runs.device_number(x) for x in (3, "3", "CUDA:3", "cpu", "cuda:x")] == [3, 3, 3, None, None]
    assert runs.plain({1: (tmp_path, {"a": None}), "b": 1.5}) == {"1": [str(tmp_path), {"a": None}], "b": 1.5}
    with pytest.raises(FileNotFoundError):
        runs.write_setting_documents(str(tmp_path), "m", "0123456")
    s = runs.TrainingSettings(train="t.jsonl", validation="v.jsonl")
    for name in ("t.jsonl", "v.jsonl"):
        (tmp_path / name).write_text("")
    model, training = (json.loads(p.read_text()) for p in runs.write_setting_documents(str(tmp_path), "m", "0123456", s))
    assert model == {"model_name": "m", "revision": "0123456", "max_sequence_length": 1024}
    assert training["full"]["max_steps"] == -1 and training["smoke"]["gradient_accumulation_steps"] == 1 and training["data"]["train"] == "t.jsonl"
    with pytest.raises(ValueError):
        runs.setting_documents("m", "abc")


def test_environment_and_statistics(spark, tmp_path):
    subprocess.run("git init -q && git -c user.name=n -c user.email=e@x commit -q --allow-empty -m one", shell=True, cwd=tmp_path, check=True)
    found = runs.environment(["pyspark", "no-such-package"], str(tmp_path))
    assert found["packages"]["pyspark"] and found["packages"]["no-such-package"] is None and len(found["commit"]) == 40 and not found["changed"]
    with runs.measured(spark, "count") as m:
        spark.range(1000, numPartitions=3).groupBy().sum().collect()
    assert m.seconds > 0 and m.jobs >= 1 and m.tasks >= 3 and m.failed_tasks == 0 and runs.as_document(m)["tasks"] == m.tasks


def test_selection_never_opens_the_benchmark(spark):
    df = queries.QUERIES["checkpoint_selection"](spark, DATA)
    assert runs.check_isolated(df, [f"{DATA}/benchmark.parquet", "/elsewhere"]) is df
    with pytest.raises(PermissionError, match="held out"):
        runs.check_isolated(spark.read.parquet(f"{DATA}/benchmark.parquet"), [f"file://{DATA}"])


def test_numbered_orders_a_table_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(sampling, "CUTS", 50)
    rows = [(f"k{(i * 7919) % 1000:04d}", i % 3 == 0) for i in range(1000)]
    frame = spark.createDataFrame(rows, "k string, s boolean").repartition(7)
    order = {k: i for i, (k, _) in enumerate(sorted(rows))}
    found = sampling.numbered(frame, ["k"]).collect()
    assert {r.k: r["__at"] for r in found} == order and {r["__n"] for r in found} == {1000}
    strata = {(k, s): i for t in (True, False) for i, (k, s) in enumerate(sorted(r for r in rows if r[1] is t))}
    assert {(r.k, r.s): r["__at"] for r in sampling.numbered(frame, ["k"], ["s"]).collect()} == strata
    assert sampling.numbered(frame.limit(0), ["k"]).count() == 0
    keys = sampling.evaluation_keys(frame, "50%", ["k"]).orderBy("k").collect()
    assert [r.evaluation_key for r in keys[:2]] == ["50%:00000", "50%:00001"]
    assert sampling.for_mode(frame, "full", ["k"], 1).count() == 1000
    assert sorted(r.k for r in sampling.for_mode(frame, "smoke", ["k"], 1).collect()) == ["k0000"]
    with pytest.raises(ValueError):
        sampling.for_mode(frame, "half", ["k"], 1)


def test_hot_fingerprint_is_claimed_once(spark):
    rows = [("hot", "evaluation" if i % 2 else "validation", f"p{i}", i) for i in range(500)] + [("hot", "train", "z", 9), ("cold", "train", "a", 1)]
    frame = spark.createDataFrame(rows, "fingerprint string, split string, source_path string, cut_line int")
    assert sorted((r.fingerprint, r.split, r.source_path) for r in examples.claim(frame).filter("claimed").collect()) == [("cold", "train", "a"), ("hot", "train", "z")]


def test_examples_count_tokens_across_lines(spark):
    """Counts from single lines equal those of the text, also where a token goes over a line's end; long windows are cut."""
    bodies = ["int  x;\n\n\n   y = 1;\n" * 12, "a b c d e f g h\n" * 200, "x\u0085y\u0085 z q\n" * 40, "w " * 3000 + "\n" + "v " * 3000 + "\nlast one\nand\nmore\nto\ncome here\n"]
    rows = [(f"lib/f{i}.c", bytearray(b.encode()), "train") for i, b in enumerate(bodies)]
    rules = examples.ExampleRules(min_prompt=1, min_completion=1)
    found = examples.file_examples(spark.createDataFrame(rows, "path string, content binary, split string"), rules)
    out = found.select("*", F.size(tokens.tokenize(F.col("prompt"))).alias("p"), F.size(tokens.tokenize(F.col("completion"))).alias("c")).collect()
    assert len(out) > 12 and all((r.p, r.c) == (r.prompt_tokens, r.completion_tokens) for r in out)
    assert max(r.p for r in out) == 896 and max(r.c for r in out) == 128


def test_general_benchmark_quotas(spark):
    rows = [(f"i{k}", f"p{k}", ext) for k in range(400) for ext in ([".cpp"] if k % 40 == 0 else [".c"] if k % 2 else [".h"])]
    found = benchmarks.general_benchmark(spark.createDataFrame(rows, "id string, source_path string, extension string"), 50).collect()
    n = {e: sum(r.extension == e for r in found) for e in (".cpp", ".c", ".h")}
    assert n == {".cpp": 10, ".c": 26, ".h": 14} and sorted(r.position for r in found) == list(range(1, 51))


def test_lift_needs_all_keys(spark):
    frame = lambda keys: spark.createDataFrame([(k, 1.0, 0.5) for k in keys], "evaluation_key string, mean_negative_log_likelihood double, token_accuracy double")
    assert metrics.prediction_lift(frame("ab"), frame("ba")).count() == 2
    for base, tuned, lacks in (("ab", "a", "tuned"), ("a", "ab", "base")):
        with pytest.raises(Exception, match=f"no score of the {lacks} model for b"):
            metrics.prediction_lift(frame(base), frame(tuned)).collect()


def test_small_likelihoods_are_summed(spark):
    rows = spark.createDataFrame([(1e-7, 1, 1), (1e-7, 1, 1), (1 / 3, 2, 1)], "negative_log_likelihood double, scored_tokens long, correct_tokens long")
    assert metrics.micro(rows).first().negative_log_likelihood == pytest.approx(2e-7 + 1 / 3, rel=1e-12)


def test_first_batch_needs_supervised_tokens(spark):
    rows = spark.createDataFrame([("a", [-100, 5]), ("b", [-100, -100])], "id string, labels array<int>")
    assert tuple(metrics.first_batch_tokens(rows, ["id"], 2).first()) == (2, 3, 1)
    with pytest.raises(Exception, match="no supervised token"):
        metrics.first_batch_tokens(rows.filter("id = 'b'"), ["id"], 2).collect()


def test_prepared_examples_are_checked(spark):
    frame = lambda p, c: spark.createDataFrame([("k:00000", p, c)], "evaluation_key string, p array<int>, c array<int>")
    row = scoring.prepared(frame([1, 2, 3], [4, 5]), "p", "c", 4).first()
    assert (row.prompt_ids, row.completion_ids) == ([2, 3], [4, 5])
    for p, c, says in (([], [1], "empty prompt"), ([1], [], "empty completion"), ([1], [1, 2, 3, 4], "too long")):
        with pytest.raises(Exception, match=says):
            scoring.prepared(frame(p, c), "p", "c", 4).collect()


def test_models_are_called_in_batches_of_like_length(spark):
    rows = [(f"k{i:03d}", [1] * (i % 17 + 1), [2] * (i % 5 + 1)) for i in range(100)]
    frame = spark.createDataFrame(rows, "evaluation_key string, prompt_ids array<int>, completion_ids array<int>").coalesce(1)

    def load():
        def model(pairs):
            lengths = [len(p) + len(c) for p, c in pairs]
            assert len(pairs) <= 8 and lengths == sorted(lengths)
            return [(float(len(c)), 1) for _, c in pairs]

        return model

    found = {r.evaluation_key: (r.negative_log_likelihood, r.scored_tokens, r.correct_tokens) for r in scoring.teacher_scores(frame, load, 8).collect()}
    assert found == {k: (float(len(c)), len(c), 1) for k, _, c in rows}

    def generator():
        return lambda prompts, most: [[7] * 3 + [0] + [9] * most for _ in prompts]

    made = scoring.generations(frame, generator, 4, eos=0, pad=0).collect()
    assert len(made) == 100 and all(r.generated_ids == [7] * min(3, r.generation_budget) and len(r.reference_ids) == r.generation_budget for r in made)
    assert sum(r.reference_was_truncated for r in made) == 20

    def named(model):
        return lambda pairs: [(float(len(model)), 0) for _ in pairs]

    per = scoring.adapter_scores(frame, spark.createDataFrame([("a",), ("bcd",)], "name string"), named, 3).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.max("negative_log_likelihood").alias("x")).collect()
    assert sorted(map(tuple, per)) == [("a", 100, 1.0), ("bcd", 100, 3.0)]


def test_model_tokenizer_of_a_library(spark):
    where = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers")
    path = where.path("byte_bpe_50k.json")

    def load():
        from tokenizers import Tokenizer

        run = Tokenizer.from_file(path)
        return lambda t: run.encode(t, add_special_tokens=False).ids

    texts = ["int main(void)\n{\n", "", None, "é"]
    encode = tokens.model_tokenizer(load)
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", encode("t").alias("ids")).collect()
    own = library.Tokenizer.from_file(path)
    assert {r.i: r.ids for r in found} == {i: None if t is None else own.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_reports(spark):
    assert spark.createDataFrame([(2.675,), (0.125,), (None,)], "x double").select(scores.report_round(2)("x").alias("r")).collect() == [(2.67,), (0.12,), (None,)]
    line = spark.range(1).select(scores.metric_line(F.lit("high"), F.lit(0.5), F.lit(1.6487), F.lit(0.81)).alias("x")).first().x
    assert line == "high: NLL=0.500000, PPL=1.6487, accuracy=81.00%"
    base, tuned = (spark.createDataFrame([(n, p, a)], "mean_negative_log_likelihood double, perplexity double, token_accuracy double") for n, p, a in ((1.0, 2.5, 0.7), (0.5, 2.0, 0.8)))
    section = reports.lift_section("cpp", 2, metrics.summary_lift(base, tuned).first())
    assert "| Mean NLL | 1.000000 | 0.500000 | +50.00% reduction |" in section and "| Token accuracy | 70.00% | 80.00% | +10.00 points |" in section
    macro = lambda x: spark.createDataFrame([(x,) * 5], ", ".join(f"{m} double" for m in metrics.MACRO))
    with_generation = reports.lift_section("cpp", 2, metrics.summary_lift(base, tuned).first(), metrics.generation_lift(macro(0.25), macro(0.5)).first())
    assert "| Exact match | 25.00% | 50.00% | +25.00 points |" in with_generation
    rows = spark.createDataFrame([(k, f"lib/{k}.c", "p" * 2000, "r", "b", "t", d) for k, d in (("a", 0.5), ("b", -0.25), ("c", 0.0))], "evaluation_key string, source_path string, prompt string, reference_completion string, base_text string, tuned_text string, token_edit_similarity_delta double")
    up, down = metrics.similarity_extremes(rows)
    report = reports.evaluation_report("full", "m", "0123", "out/a", [section], [reports.examples_section("Improvements", up), reports.examples_section("Regressions", down)])
    assert "+50.00 points" in report and "-25.00 points" in report and "lib/c.c" not in report and "p" * 1201 not in report and report.endswith("\n")
    assert reports.examples_section("None", rows.limit(0)) == ""
    counts = queries.QUERIES["validation_composition"](spark, DATA)
    assert "- source files: all " in reports.composition_section(counts)


def test_sweep_report(spark):
    lift = spark.createDataFrame([("A", 1, g, 0.1, 0.1, 0.01) for g in ("all_cpp", "high")], "model string, step int, group string, mean_nll_reduction double, perplexity_reduction double, token_accuracy_delta double")
    ranked = spark.createDataFrame([("A", True)], "model string, eligible boolean")
    decided = spark.createDataFrame([("A", "A", "select_checkpoint")], "recommended_checkpoint string, best_measured_candidate string, decision string")
    assert "Select `A`." in reports.sweep_report(lift, ranked, decided)


def test_line_numbers(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"path":"x{i}"}}\n' if i % 1000 else "broken\n" for i in range(30_000)))
    (tmp_path / "small.jsonl").write_text('\n{"path":"a"}\n\nwrong\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        schema = spark.createDataFrame([], "path string").schema
        rows = jsonl.malformed_lines(spark, str(tmp_path), schema).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    held = {(r.file.rsplit("/", 1)[1], r.number, r.line) for r in rows}
    assert held == {("big.jsonl", i + 1, "broken") for i in range(0, 30_000, 1000)} | {("small.jsonl", 4, "wrong")}


def test_ascii_sink(spark, tmp_path):
    jsonl.write_jsonl(spark.createDataFrame([("é🙂\n\"x",)], "path string"), str(tmp_path / "a"), ascii_only=True)
    (line,) = [x for p in (tmp_path / "a").glob("part-*") for x in p.read_text("ascii").splitlines()]
    assert line == json.dumps({"path": "é🙂\n\"x"}, separators=(",", ":"))


def test_strict_text(spark):
    rows = spark.createDataFrame([(bytearray(b"ok \xc3\xa9"),)], "c binary")
    assert rows.select(files.strict_text(F.col("c")).alias("t")).first().t == "ok é"
    with pytest.raises(Exception, match="(?i)utf"):
        spark.createDataFrame([(bytearray(b"\xff"),)], "c binary").select(files.strict_text(F.col("c"))).collect()


def test_counts(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), ("c",)], "k string")
    assert [tuple(r) for r in inventory.most_common(rows, "k", 2).orderBy("position").collect()] == [("b", 2, 1), ("c", 2, 2)]
    audit = examples.fingerprint_audit(spark.createDataFrame([("f",), ("f",)], "fingerprint string")).first()
    assert tuple(audit) == (2, 1, False)


def test_smoke_never_recommends(spark):
    assert selection.selected(selection.ranked(metrics.metric_groups(queries.views.scores(spark, DATA), "model", "step"), 0.5), mode="smoke").first().decision.startswith("smoke")


def test_split_streams_in_order(spark):
    """The fold of a table in many partitions is that of the table in one."""
    rows = [(f"d{i:03d}", 1 + i % 3, 100 + 37 * i % 1000, i % 4, i % 2) for i in range(300)]
    frame = spark.createDataFrame(rows, "split_group string, files long, bytes long, cpp_count long, high_cpp_count long")
    one = {r.split_group: r.split for r in split.assign_groups(frame.coalesce(1), split.SplitRules()).collect()}
    assert {r.split_group: r.split for r in split.assign_groups(frame.repartition(9), split.SplitRules()).collect()} == one and len(one) == 300


def test_normalised_lines(spark):
    assert spark.range(1).select(text.normalize_source(F.lit("a \r\nb\t\n\n")).alias("t")).first().t == "a\nb\n"
