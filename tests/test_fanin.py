import json

import pytest

from gradelake.operators.fanin import fan_in
from gradelake.plans.report import fan_in_report, write_report


def grade(prompt=(True,), language=(), programs=(("program/python-source-compiles", True),), nested="done", passed=True):
    criteria = [{"name": f"prompt/{i}", "passed": p} for i, p in enumerate(prompt)] + [{"name": f"language/{i}", "passed": p} for i, p in enumerate(language)]
    commands = [{"name": n, "graderType": "run-command", "passed": p, "details": [{"status": nested}]} for n, p in programs]
    return {"passed": passed, "details": [{"name": "group", "details": [{"metadata": {"criteria": criteria}}, *commands]}]}


def trial(name, variant="base", service="storage", status="success", **g):
    return {"evalName": name, "variant": variant, "status": status, "gradeResult": grade(**g)} | ({"service": service} if service else {})


def shard(root, folder, language, variant, expected, lines):
    d = root / folder / "reports"
    d.mkdir(parents=True)
    (root / folder / "evaluation-shard.json").write_text(json.dumps({"language": language, "variant": variant, "expectedEvaluations": expected}))
    (d / "shard-manifest.json").write_text("{}")
    (d / "results.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))


def run(spark, root, expected, services=()):
    matrix = spark.createDataFrame([(a, b, n, i) for i, (a, b, n) in enumerate(expected)], "language string, variant string, evaluations bigint, ord int")
    known = spark.createDataFrame(list(services), "eval_name string, service string")
    result = fan_in(spark, str(root), matrix, known)
    text, problems = fan_in_report(result, matrix)
    return text, problems


def test_two_complete_shards(spark, tmp_path):
    shard(tmp_path, "a", "python", "base", 1, [trial("e1", prompt=(True, True), language=(True,))])
    shard(tmp_path, "b", "dotnet", "base", 1, [trial("e2", service=None, prompt=(False, True), language=(False,), programs=(("program/dotnet-project-builds", False),))])
    text, problems = run(spark, tmp_path, [("python", "base", 1), ("dotnet", "base", 1)], [("e2", "identity")])
    assert problems == []
    assert "Completed 2 trial(s) across 2/2 shard(s)." in text
    assert "| base | 2 | 3/4 (75.0%) | 1/2 (50.0%) | 1/2 (50.0%) |" in text
    assert text.index("| identity | base | 1 |") < text.index("| storage | base | 1 |")
    assert "| dotnet | base | 1/1 | 1/2 (50.0%) | 0/1 (0.0%) | 0/1 (0.0%) |" in text
    assert "without integrity errors" in text
    assert write_report(text, problems, str(tmp_path / "r.md")) == 0 and (tmp_path / "r.md").read_text() == text


def test_outer_status_is_ignored(spark, tmp_path):
    shard(tmp_path, "a", "python", "base", 1, [trial("e1", language=(True,), passed=False)])
    text, problems = run(spark, tmp_path, [("python", "base", 1)])
    assert problems == [] and "| base | 1 | 1/1 (100.0%) | 1/1 (100.0%) | 1/1 (100.0%) |" in text


def test_missing_incomplete_duplicate_unsuccessful(spark, tmp_path):
    bad = trial("e1", status="error")
    shard(tmp_path, "a", "python", "base", 3, [bad, bad, "", '{"a":1} x'])
    text, problems = run(spark, tmp_path, [("python", "base", 3), ("java", "base", 1)])
    assert problems[0] == "Missing shard artifact: java/base"
    assert problems[1].startswith("Malformed result in python/base (results.jsonl:3): ")
    assert problems[2:] == ["Incomplete shard python/base: expected 3 result(s), found 2", "Unsuccessful trial in python/base: e1 has status error", "Duplicate result: base/e1"]
    assert "| java | base | 0/1 | n/a | n/a | n/a |" in text and "- Missing shard artifact: java/base" in text


def test_programs(spark, tmp_path):
    two = (("program/typescript-dependencies-install", True),) * 2 + (("program/typescript-type-checks", True), ("program/extra", True))
    rows = [trial("none", programs=()), trial("twice", programs=two), trial("broken", programs=(("program/typescript-dependencies-install", True), ("program/typescript-type-checks", False)), nested="error")]
    shard(tmp_path, "a", "typescript", "base", 3, rows)
    text, problems = run(spark, tmp_path, [("typescript", "base", 3)])
    assert problems == [
        "No program check results found: base/none", "Missing program check: base/none/program/typescript-dependencies-install", "Missing program check: base/none/program/typescript-type-checks",
        "Duplicate program check: base/twice/program/typescript-dependencies-install", "Unexpected program check: base/twice/program/extra",
        "Program check error: base/broken/program/typescript-dependencies-install", "Program check error: base/broken/program/typescript-type-checks",
    ]
    assert "| base | 3 | 3/3 (100.0%) | 0/0 (n/a) | 2/6 (33.3%) |" in text


def test_manifests_and_mismatches(spark, tmp_path):
    shard(tmp_path, "a", "python", "base", 2, [trial("e1", variant="other", service=None)])
    shard(tmp_path, "b", "python", "base", 1, [trial("e9")])
    shard(tmp_path, "c", "go", "base", 1, [trial("e2", programs=(("program/go-project-tests", True),))])
    _, problems = run(spark, tmp_path, [("python", "base", 1)])
    assert problems == [
        "Duplicate shard manifest: python/base", "Unexpected shard artifact: go/base", "Manifest count mismatch in python/base: expected 1, manifest reports 2",
        "Variant mismatch in python/base: result e1 reports other", "Service tag not found for e1",
    ]


def test_empty_criteria_end_the_search(spark, tmp_path):
    row = trial("e1")
    row["gradeResult"] = {"metadata": {"criteria": []}, "details": [{"metadata": {"criteria": [{"name": "prompt/x", "passed": True}]}}, {"graderType": "run-command", "name": "program/python-source-compiles", "passed": 1}]}
    shard(tmp_path, "a", "python", "base", 1, [row, "null"])
    _, problems = run(spark, tmp_path, [("python", "base", 1)])
    assert problems[0].startswith("Malformed result") and problems[1:] == ["No criterion results found: base/e1"]


def test_repeats_across_languages_and_nested_manifests(spark, tmp_path):
    shard(tmp_path, "a", "python", "base", 1, [trial("e1")])
    shard(tmp_path, "a/inner", "java", "base", 1, [trial("e1")])
    _, problems = run(spark, tmp_path, [("python", "base", 1), ("java", "base", 1)])
    assert "Duplicate result: base/e1" in problems and "Incomplete shard python/base: expected 1 result(s), found 2" in problems


def test_malformed_manifest_is_an_error(spark, tmp_path):
    (tmp_path / "evaluation-shard.json").write_text("{")
    with pytest.raises(Exception):
        run(spark, tmp_path, [("python", "base", 1)])
