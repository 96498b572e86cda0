"""JSON as it is written: any depth, numbers beyond double, long integers, blanks of the language that wrote the files."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradelake.operators import gradetree
from gradelake.operators.gradetree import first_criteria, nodes, oracle_leaves, run_commands
from gradelake.operators.oracle import classify, validate
from gradelake.plans.report import every_line, write_report
from gradelake.sources import files
from gradelake.sources.jsontext import LEVELS, held_json, strict_json, strict_variant, truthy, written_json


def nested(levels):
    return "[" * levels + "]" * levels


def command(metadata):
    return '{"graderType":"run-command","name":"c","passed":true,"metadata":' + metadata + "}"


@pytest.mark.parametrize("levels", [10, 950, 1_500, 60_000])
def test_a_deep_value_keeps_its_node(spark, levels):
    text = '{"details":[' + command('{"deep":' + nested(levels) + ',"criterion":"prompt/x"}') + "]}"
    walked = nodes(spark.createDataFrame([(1, text)], "id int, tree string"))
    rows = walked.orderBy("number").collect()
    assert [r.depth for r in rows] == [0, 1] and [(r.name, r.passed, r.error) for r in run_commands(walked).collect()] == [("c", True, False)]
    assert [(r.category, r.name) for r in oracle_leaves(walked).collect()] == [("program", "prompt/x")]
    if levels > 1_000:
        assert strict_json(rows[1].whole)["metadata"]["criterion"] == "prompt/x" and rows[1].whole.count("[") == levels
    line = '{"evalName":"e","variant":"v","status":"success","gradeResult":' + text + "}"
    r = files.trials(spark.createDataFrame([(line,)], "text string")).first()
    assert (r.message, r.eval_name, [tuple(p) for p in r.programs]) == (None, "e", [("c", True, False)])


@pytest.mark.parametrize("levels", [10, 1_500, 60_000])
def test_readers_of_deep_lines(spark, tmp_path, levels):
    row = {"scenario": "s", "language": "go", "status": "passed", "error": None, **{k: {"passed": 1, "total": 1, "failures": []} for k in ("prompt", "languageChecks", "program")}}
    (tmp_path / "oracle-results.jsonl").write_text(json.dumps(row)[:-1] + ',"more":' + nested(levels) + "}\n")
    rows = files.oracle_lines(spark, str(tmp_path))
    got = validate(rows).first()
    assert got.errors == [] and (rows.first().whole is not None) == (levels > LEVELS)
    (tmp_path / "cases.jsonl").write_text('{"id":"1","query":"q","groundTruth":"g","more":' + nested(levels) + "}\n")
    assert files.eval_cases(spark, str(tmp_path / "cases.jsonl")).first().id == "1"


def test_numbers_beyond_double(spark, tmp_path):
    huge = "9" * 5000
    lines = [f'{{"a":{x},"id":"{k}","query":"q","groundTruth":"g"}}' for k, x in enumerate(("1e999", "-1e999", huge, "9007199254740993", "123456789012345678901234567890"))]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    assert files.eval_cases(spark, str(tmp_path / "c.jsonl")).count() == 5
    (tmp_path / "oracle-results.jsonl").write_text("\n".join(lines))
    rows = files.oracle_lines(spark, str(tmp_path)).orderBy("ord.line")
    assert [r[0] for r in rows.select(F.try_variant_get("row", "$.a", "string")).collect()] == ["Infinity", "-Infinity", "Infinity", "9007199254740993", "123456789012345678901234567890"]
    trees = spark.createDataFrame([(k, f'{{"graderType":"run-command","name":"n","passed":{x}}}') for k, x in enumerate(("1e999", huge, "0", "-0.0", '""', '"no"', "[]", "{}", "null"))], "id int, tree string")
    want = [True, True, False, False, False, True, True, True, False]
    assert [r.passed for r in run_commands(nodes(trees)).orderBy("id").collect()] == want
    texts = trees.select("id", F.concat(F.lit('{"evalName":"e","variant":"v","status":"s","gradeResult":'), "tree", F.lit("}")).alias("text"))
    assert [r.programs[0].passed for r in files.trials(texts).orderBy("id").collect()] == want
    # A count that is infinite is no whole number.
    bad = {"scenario": "s", "language": "go", "status": "failed", "error": None, **{k: {"passed": 0, "total": 1, "failures": []} for k in ("prompt", "languageChecks", "program")}}
    (tmp_path / "oracle-results.jsonl").write_text(json.dumps(bad).replace('"passed": 0', '"passed": 1e999', 1))
    assert validate(files.oracle_lines(spark, str(tmp_path))).first().errors == ["Result 1.prompt.passed must be a non-negative integer"]


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(json_values)
def test_written_values_read_back(value):
    from gradelake.sources.jsontext import _parts, printable

    text = written_json(value)
    try:
        json.dumps(value, ensure_ascii=False).encode()
    except UnicodeEncodeError:
        return
    assert strict_json(text) == value and strict_json(printable("".join(_parts(value, None)))) == value and held_json(value) == (text, None)


def test_held_values_end_at_a_level():
    value = leaf = []
    for _ in range(2_000):
        leaf.append([])
        leaf = leaf[0]
    held, whole = held_json({"a": value, "b": {"c": 1}})
    assert held.count("[") == LEVELS and whole.count("[") == 2_001 and strict_json(held)["b"] == {"c": 1}


STRICT = ['{"a":1} x', '{"a":1}]', '{"a":1},"mark":"x"} {"b":2', '{"a":1,"a":2}', '{"a":"\\ud800"}', '{"a":"\\u00e9"}', "null", "", '{"a":1}\x1c', "﻿{}", '{"a":1,}', " \t{}\r"]


def test_strict_variant_agrees_with_the_parser(spark):
    rows = spark.createDataFrame([(x,) for x in STRICT], "t string").select("t", F.to_json(strict_variant("t")).alias("j")).collect()
    for r in rows:
        if r.j is not None:  # what Spark reads, the parser reads alike; all else the parser decides on
            assert strict_json(r.t) == json.loads(r.j)
    read = {r.t for r in rows if r.j is not None}
    assert {'{"a":"\\u00e9"}', " \t{}\r", "null"} <= read and not read & {'{"a":1} x', '{"a":1}]', '{"a":1},"mark":"x"} {"b":2', '{"a":1}\x1c', '{"a":1,"a":2}'}


def tree(depth, width, seed):
    import random

    rng = random.Random(seed)

    def one(level):
        node = {"name": f"n{rng.randrange(9)}", "status": rng.choice(["ok", "ok", "ok", "error", 5]), "passed": rng.choice([True, False, 1, 0, "x", "", None, [], 2.5])}
        if rng.random() < 0.4:
            node["graderType"] = "run-command"
        if rng.random() < 0.2:
            node["metadata"] = {"criteria": [{"name": rng.choice(["prompt/a", 5, None]), "passed": rng.choice([True, 0, "t"])}, 7]}
        if level < depth and rng.random() < 0.9:
            node["details"] = [rng.choice([None, 3, "x", []]) if rng.random() < 0.1 else one(level + 1) for _ in range(rng.randrange(width))]
        elif rng.random() < 0.2:
            node["details"] = "none"
        return node

    return one(0)


def test_spark_and_the_parser_walk_alike(spark):
    texts = [(k, json.dumps(tree(3 + k % 15, 2 + (k % 15 < 5) * 2, k))) for k in range(40)] + [(40, "5"), (41, None), (42, '{"details":[' * 60 + '{"status":"error"}' + "]}" * 60)]
    df = spark.createDataFrame(texts, "id int, tree string")
    shape = lambda d: sorted((r.id, r.depth, r.number, json.dumps(json.loads(r.j), sort_keys=True), r.error) for r in d.select("id", "depth", "number", F.to_json("node").alias("j"), "error").collect())
    want = shape(gradetree._parsed(df.where("tree is not null")))
    for step in (1, 2, 6):
        if step == 6:
            assert shape(nodes(df, step=step)) == want
        shallow = df.where("id < 5")
        assert shape(nodes(shallow, step=step)) == [w for w in want if w[0] < 5]
    assert shape(nodes(df.where("tree is not null").withColumn("tree", F.parse_json("tree")))) == want
    assert max(w[1] for w in want) == 60
    # Equal ids are trees of their own.
    twice = shape(nodes(df.where("id = 42").union(df.where("id = 42"))))
    assert len(twice) == 122 and twice[::2] == twice[1::2]


def test_spark_and_the_parser_read_trials_alike(spark):
    lines = [json.dumps({"evalName": f"e{k}", "variant": "v", "status": "success", "service": [None, "s", "", 5][k % 4], "gradeResult": tree(2 + k % 9, 3, k)}) for k in range(60)]
    lines += ['{"evalName":5,"variant":"v","status":"s"}', '{"variant":"v"}', "[]", "5", "{", "", '{"evalName":"e","variant":"v","status":"s","gradeResult":5}']
    got = files.trials(spark.createDataFrame(list(enumerate(lines)), "id int, text string")).orderBy("id").collect()
    for r, line in zip(got, lines):
        want = files.parsed_trial(line)
        assert {k: v for k, v in r.asDict(recursive=True).items() if k != "id"} == {**dict.fromkeys(["eval_name", "variant", "status", "service", "criteria", "programs"]), **want}


def test_truth(spark):
    rows = [("true", True), ("false", False), ("null", False), ("0", False), ("0.0", False), ("1e999", True), ('""', False), ('"false"', True), ("[]", True), ("{}", True), ("-3", True)]
    got = spark.createDataFrame(rows, "t string, w boolean").select(truthy(F.parse_json("t")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


@pytest.mark.parametrize("physical", [False, True])
def test_blank_lines_are_those_of_trim(spark, tmp_path, physical):
    """A line of U+001C is no blank line, one of U+FEFF is; numbers are the same however the file is split."""
    lines = ["\x1c"] * 20 + ["﻿", "　 ", ""] + [f"r{i}" for i in range(30)]
    (tmp_path / "x.txt").write_text("\n".join(lines))
    blank = [not x.strip(files.BLANK) for x in lines]
    want, n = [], 0
    for x, b in zip(lines, blank):
        n += physical or not b
        if not b:
            want.append((n, x))
    for size in ("16", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert sorted((r.line, r.text) for r in files.numbered_lines(spark, str(tmp_path), "x.txt", physical).collect()) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_classified_without_python(spark):
    tree = {"details": [{"name": "panel/criterion/1", "passed": True, "metadata": {"criterion": "prompt/a"}}, {"graderType": "run-command", "name": "p", "passed": False, "evidence": "e"}]}
    df = spark.createDataFrame([(1, json.dumps({"status": "success", "gradeResult": tree}))], "id int, j string").select("id", F.parse_json("j").alias("outcome"))
    out = classify(df)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    r = out.first()
    assert (r.status, r.prompt.passed, r.program.total, r.program.failures[0].evidence) == ("failed", 1, 1, "e")


def test_outcomes(spark):
    df = spark.createDataFrame([(1, '\r\n{"a":1}\n'), (2, ""), (3, "1\n2"), (4, None), (5, '{"a":1,"a":2}')], "id int, stdout string")
    got = {r.id: (r.j, r.error) for r in files.outcomes(df).select("id", F.to_json("outcome").alias("j"), "error").collect()}
    assert got == {1: ('{"a":1}', None), 2: (None, "Expected one oracle result, received 0"), 3: (None, "Expected one oracle result, received 2"), 4: (None, "The command gave no standard output"), 5: ('{"a":2}', None)}
    with pytest.raises(Exception, match="Malformed output"):
        files.outcomes(spark.createDataFrame([(1, "{")], "id int, stdout string")).collect()


def test_a_written_report_lists_all(spark, tmp_path, monkeypatch):
    rows = spark.range(500).select(F.col("id").alias("ord"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("problem"))
    text = "# Head\n\n## Integrity\n\n- p0\n- and 499 more problems\n"
    assert write_report(text, ["p0"], str(tmp_path / "r.md"), every_line(rows, "ord")) == 1
    assert (tmp_path / "r.md").read_text() == "# Head\n\n## Integrity\n\n" + "".join(f"- p{i}\n" for i in range(500))
