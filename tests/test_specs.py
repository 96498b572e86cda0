"""Specs by indentation, and the rules of a catalog, each broken once."""

import pytest

from gradelake import queries
from gradelake.sources.specs import CatalogRules, Program, broken_rules, entries, grader_rows, graders

RULES = CatalogRules(
    criteria={"go": 0, "python": 2}, programs={"go": (Program("program/tests", "go", ("test", "./..."), "3m"),), "python": (Program("program/compiles", "python", ("check.py",), "30s"),)},
    model="m-1", scopes=("small", "large"), files=(("../ignore", ".ignore"), ("../AGENTS.md", "AGENTS.md")), own_files={"python": ("../check.py", "check.py")}, sentence="must start with x. Never copy", no_criterion="language/old",
)
SPEC = """name: a-spec
# a comment
agent_environment:
  files:
    - src: ../ignore
      dest: .ignore
    - src: ../AGENTS.md
      dest: AGENTS.md
    - src: ../check.py
      dest: check.py
scoring:
  weights: {}
defaults:
  runs: 1
stimuli:
  - name: one
    prompt: |-
      Write: this
        - type: panel

      required: no key, a text
    tags:
      language: "python"
      scope: small
    graders:
      - type: panel
        name: 'prompt/all'
        config:
          prompt: |-
            The value must start with x. Never
            copy it.
          models:
          - m-1
          threshold: 0
          overall_threshold: 0
          evidence:
            - diff
          criteria:
            - name: prompt/a
              weight: 1
            - name: language/b
            - name: language/c
      - type: run-command
        name: program/compiles
        config:
          command: python
          args:
            - check.py
          timeout: 30s
"""


def broken(spark, text):
    return sorted((r.rule, r.found, r.wanted) for r in broken_rules(spark.createDataFrame([("p", text)], "path string, value string"), RULES).collect())


def test_entries(spark):
    rows = entries(spark.createDataFrame([("p", SPEC.replace("\n", "\r\n"))], "path string, value string")).collect()
    at = {(r.place, tuple(r["items"])): r.value for r in rows}
    lines = SPEC.split("\n")
    n = lambda x: next(i for i, y in enumerate(lines, 1) if x in y)
    one, panel = n("- name: one"), lines.index("      - type: panel") + 1
    assert at["name", ()] == "a-spec" and at["scoring/weights", ()] == "{}" and at["stimuli/#/tags/language", (one,)] == "python"
    assert at["stimuli/#/graders/#/config/models/#", (one, panel, n("- m-1"))] == "m-1"
    assert [r.value for r in rows if r.place == "stimuli/#/prompt/|"] == ["Write: this", "- type: panel", "", "required: no key, a text"]
    assert [r.value for r in rows if r.place == "stimuli/#/graders/#/config/criteria/#/name"] == ["prompt/a", "language/b", "language/c"]
    got = {r.name: (r.type, r.command, r.args, r.timeout) for r in graders(entries(spark.createDataFrame([("p", SPEC)], "path string, value string")), ["path"]).collect()}
    assert got == {"prompt/all": ("panel", None, [], None), "program/compiles": ("run-command", "python", ["check.py"], "30s")}


def test_a_good_spec_breaks_nothing(spark):
    assert broken(spark, SPEC) == []


@pytest.mark.parametrize(
    "old, new, want",
    [
        ("      - type: panel\n        name", "      - type: paper\n        name", [("one panel", 0, 1)]),
        ("- type: run-command", "- type: program", [("no grader of type program", 1, 0), ("program grader program/compiles", 0, 1), ("program graders", 0, 1)]),
        ("  weights: {}", "  weights:\n    a: 1\n  threshold: 1", [("no threshold of the scoring", 1, 0), ("no weights", 0, 1)]),
        ("              weight: 1", "              required: true", [("nothing required", 1, 0)]),
        ("          threshold: 0", "          threshold: 1", [("threshold of zero", 0, 1)]),
        ("overall_threshold: 0", "overall_threshold: 0.5", [("overall threshold of zero", 0, 1)]),
        ("language/c", "language/old", [("no such criterion", 1, 0)]),
        ("language/c", "prompt/c", [("language criteria", 1, 2)]),
        ("scope: small", "scope: other", [("one scope", 0, 1)]),
        ("    tags:", "    environment:\n      a: b\n    tags:", [("no environment of a stimulus", 1, 0)]),
        ('"python"', "cobol", [("a known language", 0, 1), ("staged file check.py", 1, 0)]),
        ("- m-1", "- m-2\n          - m-1", [("first model", 0, 1)]),
        ("- diff", "- other\n            - diff", [("first evidence is diff", 0, 1)]),
        ("copy it", "take it", [("sentence of the prompt", 0, 1)]),
        ("../AGENTS.md", "../A.md", [("staged file AGENTS.md", 0, 1)]),
        ("    - src: ../check.py\n      dest: check.py\n", "", [("staged file check.py", 0, 1)]),
        ("            - check.py", "            - check.py\n            - -v", [("program grader program/compiles", 0, 1)]),
    ],
)
def test_each_rule(spark, old, new, want):
    assert SPEC.count(old) >= 1
    assert broken(spark, SPEC.replace(old, new, 1)) == want


def test_an_empty_spec_is_no_crash(spark):
    assert {r[0] for r in broken(spark, "")} >= {"one panel", "a known language"}
    assert entries(spark.createDataFrame([("p", None)], "path string, value string")).collect() == []


def test_specs_are_judged_one_by_one(spark):
    """No rows of all specs are gathered in a task: nothing is shuffled or joined, at any number of specs."""
    files = spark.createDataFrame([(i, SPEC if i % 2 else SPEC.replace("- diff", "- other")) for i in range(40)], "path bigint, value string")
    out = broken_rules(files, RULES)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Aggregate "))
    assert sorted(map(tuple, out.collect())) == [(i, "first evidence is diff", 0, 1) for i in range(0, 40, 2)]


def test_graders_of_each_spec_without_a_shuffle(spark):
    second = SPEC.split("    graders:\n")[1].replace("program/compiles", "program/more").replace("timeout: 30s", "timeout: 1m")
    files = spark.createDataFrame([("p", SPEC), ("q", SPEC + second), ("r", None), ("s", "")], "path string, value string")
    out = grader_rows(files)
    want = graders(entries(files), ["path"])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.path, r["items"])
    assert sorted(out.collect(), key=key) == sorted(want.select(*out.columns).collect(), key=key) and out.count() == 6


def test_specs_of_a_table_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(queries, "SPECS_OF_A_TASK", 20)
    made = queries._specs(spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() == -(-made.count() // 20)
