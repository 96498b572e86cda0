import json

import pytest
from pyspark.sql import functions as F

from gradelake.operators.gradetree import first_criteria, nodes, run_commands
from gradelake.operators.oracle import classify, language_matrix, summarize
from gradelake.plans.report import oracle_report
from gradelake.sources import files


def row(scenario="s1", language="python", status="passed", error=None, prompt=(5, 5), checks=(2, 2), program=(1, 1), failures=()):
    part = lambda pt, f=(): {"passed": pt[0], "total": pt[1], "failures": list(f)}
    return {"scenario": scenario, "language": language, "status": status, "error": error, "prompt": part(prompt, failures), "languageChecks": part(checks), "program": part(program)}


def report(spark, tmp_path, rows, expected):
    (tmp_path / "oracle-results.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows))
    return oracle_report(summarize(files.oracle_lines(spark, str(tmp_path)), expected), expected)


def test_failures_are_no_integrity_errors(spark, tmp_path):
    rows = [row(), row("s2", status="failed", prompt=(4, 5), checks=(2, 3), failures=[{"name": "prompt/x", "evidence": "a|b\nc"}]), row("s3", "dotnet", "error", "boom", (0, 0), (0, 0), (0, 0))]
    text, integrity = report(spark, tmp_path, rows, 3)
    assert integrity == []
    assert "| python | 2 | 9/10 (90.0%) | 4/5 (80.0%) | 2/2 (100.0%) | 0 |" in text
    assert "| dotnet | 1 | 0/0 (n/a) | 0/0 (n/a) | 0/0 (n/a) | 1 |" in text
    assert "| s2 | prompt | prompt/x | a\\|b c |" in text and "| s3 | infrastructure | - | boom |" in text
    assert "All expected oracle results were collected." in text


def test_malformed_rows(spark, tmp_path):
    bad = row(" ", 5, "odd", error="x", prompt=(6, 5), program=(-1, 0.5))
    bad["languageChecks"] = None
    bad["prompt"]["failures"] = [{"name": "", "evidence": "x"}, {"name": "n"}]
    _, integrity = report(spark, tmp_path, [row(), bad, None, row("s4", status="error"), row("s5", program=(0, 0))], 5)
    assert integrity == [
        "Result 2 has an invalid scenario", "Result 2 has an invalid language", "Result 2 has an invalid status", "Result 2 non-error status must have error: null",
        "Result 2.prompt.passed cannot exceed Result 2.prompt.total", "Result 2.prompt.failures[0] is invalid", "Result 2.prompt.failures[1] is invalid",
        "Result 2.languageChecks must be an object", "Result 2.program.passed must be a non-negative integer", "Result 2.program.total must be a non-negative integer",
        "Result 3 must be an object", "Result 4 error status requires an error message", "Result 5 passed status conflicts with check totals",
    ]


def test_duplicates_are_counted_and_reported(spark, tmp_path):
    text, integrity = report(spark, tmp_path, [row(), row()], 3)
    assert integrity == ["Duplicate scenario result: s1", "Expected 3 scenario results, received 2"]
    assert "| python | 2 | 10/10 (100.0%)" in text and "\nNone.\n" in text


def test_malformed_line_is_an_error(spark, tmp_path):
    (tmp_path / "oracle-results.jsonl").write_text("{")
    with pytest.raises(Exception):
        files.oracle_lines(spark, str(tmp_path)).collect()


def leaf(name, criterion, passed, evidence="e"):
    return {"name": f"panel/criterion/{name}", "metadata": {"criterion": criterion}, "passed": passed, "evidence": evidence}


OUTCOMES = {
    "ok": {"status": "success", "gradeResult": {"details": [leaf("a", "prompt/a", True), {"details": [leaf("b", "language/b", True)]}]}},
    "no prompt": {"status": "success", "gradeResult": {"details": [leaf("b", "language/b", True)]}},
    "failed language": {"status": "success", "gradeResult": {"details": [leaf("a", "prompt/a", True), leaf("b", "language/b", False), {"graderType": "run-command", "name": "p"}]}},
    "error": {"status": "error", "error": "boom"},
    "nothing": {"status": "success"},
    "absent": {"status": "success", "gradeResult": {"details": [{"name": "panel/criterion/a", "metadata": {"criterion": "prompt/a"}}, {"name": "x", "metadata": {"criterion": "prompt/no"}, "passed": False}]}},
}


def test_classify(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in OUTCOMES.items()], "id string, j string").select("id", F.parse_json("j").alias("outcome"))
    got = {r.id: r for r in classify(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"ok": "passed", "no prompt": "failed", "failed language": "failed", "error": "error", "nothing": "error", "absent": "failed"}
    assert got["error"].error == "boom" and got["nothing"].error == "Oracle did not return a grade result"
    assert got["failed language"].languageChecks.failures[0].name == "language/b" and got["failed language"].program.failures[0].name == "p"
    assert (got["ok"].prompt.passed, got["ok"].languageChecks.total, got["ok"].program.total) == (1, 1, 0)


def test_tree_walks_agree(spark):
    deep = {"graderType": "run-command", "name": "outer", "passed": True, "details": [{"details": {"no": "list"}}, {"details": [{"graderType": "run-command", "name": "inner", "details": [{"status": "error"}]}]}, {"metadata": {"criteria": [{"name": "late", "passed": True}]}}]}
    for _ in range(30):
        deep = {"details": [deep, 5, None, "x"]}
    trees = [deep, {"metadata": {"criteria": []}, "details": [{"metadata": {"criteria": [{"name": "x"}]}}]}, {"details": 3}]
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "id int, j string").select("id", F.parse_json("j").alias("tree"))
    walked = nodes(df)
    commands = {(r.id, r.name): (r.passed, r.error) for r in run_commands(walked).collect()}
    assert commands == {(0, "outer"): (True, True), (0, "inner"): (False, True)}
    criteria = {r.id: r.criteria for r in first_criteria(walked).collect()}
    for i, t in enumerate(trees):
        want = files.parsed_trial(json.dumps({"gradeResult": t}))
        assert [c.name for c in criteria.get(i) or []] == [c["name"] for c in want["criteria"]]
        assert {(c["name"], c["passed"], c["error"]) for c in want["programs"]} == {(n, *v) for (k, n), v in commands.items() if k == i}


def test_matrix(spark):
    rows = language_matrix(spark.createDataFrame([("b",), ("A",), ("a",), ("b",)], "language string")).collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("A", 1), ("b", 2)]


def test_round_trip_of_the_sink(spark, tmp_path):
    df = spark.createDataFrame([row(), row("s2", status="error", error="x")], files.ORACLE_SCHEMA)
    files.write_oracle_rows(df, str(tmp_path / "out"))
    back = files.oracle_lines(spark, str(tmp_path / "out"), "*.json")
    assert summarize(back, 2).integrity.count() == 0
