"""Trees of any depth, strict JSON, half surrogates, and line numbers in files that are read in splits."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradelake.operators import ops, scans
from gradelake.operators.gradetree import first_criteria, nodes, run_commands
from gradelake.sources import files
from gradelake.sources.jsontext import _deep, strict_json
from gradelake.streaming import streams

LEVELS = 5_000


def deep_text(inner: str, levels: int = LEVELS) -> str:
    return '{"details":[' * levels + inner + "]}" * levels


COMMAND = '{"graderType":"run-command","name":"c","passed":true,"details":[{"status":"error"}]},{"metadata":{"criteria":[{"name":"x","passed":true}]}}'


def test_deep_trees(spark):
    df = spark.createDataFrame([(1, deep_text(COMMAND)), (2, None), (3, "5")], "id int, tree string")
    walked = nodes(df).cache()
    assert {r.id: r["count"] for r in walked.groupBy("id").count().collect()} == {1: LEVELS + 3}
    assert [tuple(r) for r in run_commands(walked).select("id", "name", "passed", "error").collect()] == [(1, "c", True, True)]
    assert [c.name for c in first_criteria(walked).first().criteria] == ["x"]
    line = '{"evalName":"e","variant":"v","status":"success","gradeResult":' + deep_text(COMMAND) + "}"
    r = files.trials(spark.createDataFrame([(line,)], "text string")).first()
    assert (r.message, r.eval_name, r.criteria[0].name, r.programs[0].error) == (None, "e", "x", True)


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_deep_parser_equals_the_library(value):
    for text in (json.dumps(value), json.dumps(value, indent=1, ensure_ascii=False)):
        assert _deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "{'a':1}", "01", "1 x", "NaN", "[", '"a', '{"a":1} x', "tru", "-", "[1,", '{"a":']) 
def test_malformed(text):
    for parse in (strict_json, _deep):
        with pytest.raises(ValueError):
            parse(text)


def test_half_surrogates(spark):
    r = files.trials(spark.createDataFrame([('{"evalName":"a\\ud800b","variant":"v","status":"s"}',), ("null",)], "text string")).collect()
    assert r[0].eval_name == "a�b" and r[1].message


def test_oracle_lines_are_strict(spark, tmp_path):
    (tmp_path / "oracle-results.jsonl").write_text('\n{"scenario":"a","scenario":"b"}\r\n')
    assert files.oracle_lines(spark, str(tmp_path)).select(F.col("ord.line"), F.expr("variant_get(row, '$.scenario', 'string') AS s")).collect() == [(1, "b")]
    (tmp_path / "oracle-results.jsonl").write_text('{"scenario":"a"} trailing')
    with pytest.raises(Exception, match="Malformed oracle result on line 1"):
        files.oracle_lines(spark, str(tmp_path)).collect()
    case = tmp_path / "c.jsonl"
    case.write_text('\n{"id":"1","query":"q","groundTruth":"g"} trailing')
    with pytest.raises(Exception, match="evaluation case on line 2"):
        files.eval_cases(spark, str(case)).collect()


@pytest.mark.parametrize("physical", [False, True])
def test_line_numbers_over_splits(spark, tmp_path, physical):
    lines = [f"line {i}" * (i % 7) + ("\r" if i % 3 else "") for i in range(3000)]
    (tmp_path / "a").mkdir()
    for name in ("a/x.txt", "x.txt"):
        (tmp_path / name).write_text("\n".join(lines), newline="")
    want, n = {}, 0
    for i, x in enumerate(lines):
        n += physical or bool(x.strip())
        if x.strip():
            want[n] = x.removesuffix("\r")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = files.numbered_lines(spark, str(tmp_path), "x.txt", physical)
        assert rows.rdd.getNumPartitions() >= 1
        got = rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2 * len(want) and {(r.line, r.text) for r in got} == set(want.items())


def test_one_outcome_and_scenario_folders(spark, tmp_path):
    assert files.one_outcome('\n{"a":1}\n') == {"a": 1}
    for bad in ("", "1\n2", "x"):
        with pytest.raises(ValueError):
            files.one_outcome(bad)
    for name, service, language in (("b", "storage", "go"), ("a", "sto.age", "go"), ("c", "storage", "java")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "eval.yaml").write_text(f"name: {name}\ntags:\n  service: {service}\n  language: {language}\n")
    pick = lambda **k: [r.scenario for r in files.scenario_directories(spark, str(tmp_path), **k).collect()]
    assert pick(every=True) == ["a", "b", "c"] and pick(service="sto.age") == ["a"] and pick(service="storage", language="go") == ["b"] and pick(names=["c", "zz"]) == ["c"]
    for bad in ({}, {"every": True, "names": ["a"]}, {"names": ["-x"]}, {"service": ""}):
        with pytest.raises(ValueError):
            pick(**bad)


def test_malformed_subject_is_an_error(spark):
    from gradelake.functions.scalars import checked_subject

    df = spark.createDataFrame([("/containers/c/blobs/a%20b",)], "s string")
    assert tuple(df.select(checked_subject("s").alias("x")).first().x) == ("c", "a b")
    with pytest.raises(Exception, match="Unexpected event subject"):
        spark.createDataFrame([("/nothing",)], "s string").select(checked_subject("s")).collect()


def test_circuit(spark):
    calls = [(0, "t"), (1, "t"), (2, "t"), (3, "ok"), (31, "t"), (32, "t"), (33, "ok"), (34, "t"), (35, "t"), (36, "other"), (37, "t"), (38, "t"), (39, "t"), (69, "t")]
    df = spark.createDataFrame([("k", s, c) for s, c in calls], "k string, s bigint, c string").withColumn("at", F.timestamp_seconds("s"))
    rows = scans.circuit(df, ["k"], "at", F.col("c") == "t", F.col("c") == "other").orderBy("s").collect()
    assert [r.s for r in rows if r.refused] == [3, 31] and [r.streak for r in rows] == [1, 2, 3, 3, 3, 1, 0, 1, 2, 0, 1, 2, 3, 1]


def test_small_operators(spark):
    turns = spark.createDataFrame([(1, 0, "user", ["q"]), (1, 1, "assistant", ["a", None, "b"]), (1, 2, "assistant", None)], "conv_id int, turn int, role string, parts array<string>")
    assert [(r.turn, r.pos, r.text) for r in ops.assistant_texts(turns).collect()] == [(1, 0, "a"), (1, 2, "b")]
    states = spark.createDataFrame([("a", None), ("a", "running"), ("b", None)], "k string, s string")
    assert {tuple(r) for r in ops.any_running(states, ["k"], F.col("s") == "running").collect()} == {("a", True), ("b", False)}
    pages = spark.createDataFrame([("q", 0.1)] * 10, "k string, c double")
    assert str(ops.total_charge(pages, ["k"], F.col("c")).first().charge) == "1.00"
    rows = spark.createDataFrame([("x", "panel"), ("x", "panel"), ("y", "panel"), ("y", "program")], "k string, kind string")
    broken = ops.broken_invariants(rows, ["k"], {"one panel": (F.col("kind") == "panel", 1, 1), "a program": (F.col("kind") == "program", 1, None)})
    assert {tuple(r) for r in broken.collect()} == {("x", "one panel", 2), ("x", "a program", 0)}


def test_queue_batches_and_polling(spark, tmp_path):
    streams.produce(spark.range(25), str(tmp_path / "in"))
    assert max(r["count"] for r in spark.read.parquet(str(tmp_path / "in")).groupBy(F.input_file_name()).count().collect()) <= 10
    sizes = []
    streams.event_batches(streams.read_events(spark, str(tmp_path / "in"), "id bigint"), lambda rows, n: sizes.extend(r["count"] for r in rows.groupBy("batch").count().collect()), str(tmp_path / "cp"), 10, "id")
    assert sum(sizes) == 25 and max(sizes) == 10
    got = streams.received(spark.range(100), "id", 3).collect()
    assert len(got) == 100 and {r.consumer for r in got} == {0, 1, 2}
    assert max(sum(x.consumer == r.consumer and x.receive == r.receive for x in got) for r in got) <= 5
    states = iter(["running", "running", "done"])
    assert streams.poll(lambda: next(states), {"done", "failed"}, 5, 0.01) == "done"
    with pytest.raises(TimeoutError):
        streams.poll(lambda: "running", {"done"}, 0.05, 0.02)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from gradelake.sources.staging import shared_dir

    def session(master, folder):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: folder or d), sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://x", "s3://b/c/")) == "s3://b/c"
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master, ""))
    assert shared_dir(session("local[2]", "")).startswith("file://")
