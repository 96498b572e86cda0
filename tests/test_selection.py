import pytest
from pyspark.sql import functions as F

from gradelake.operators.selection import Selection, Variants, group_by_language, parse_tag_filters, select_entries, shard_matrix
from gradelake.sources import files

VARIANTS = Variants(("base", "plus", "full"), {"go": ("base", "plus")})


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("catalog")
    specs = [("python", "identity"), ("python", "tables"), ("java", "identity"), ("go", "tables"), ("typescript", "tables")]
    for language in ("python", "java", "typescript", "go"):
        mine = [s for s in specs if s[0] == language]
        (root / "experiments" / language).mkdir(parents=True)
        lines = "\n".join(f"  - ../../scenarios/{s}-{lang}/eval.yaml" for lang, s in mine)
        (root / "experiments" / language / "experiment.yaml").write_text(f"name: x\nevals:\n{lines}\nvary:\n  - environment\n")
        for lang, s in mine:
            folder = root / "scenarios" / f"{s}-{lang}"
            folder.mkdir(parents=True)
            (folder / "eval.yaml").write_text(f'name: {s}-{lang}\nstimuli:\n  - name: a\n    tags:\n      service: "{s}"\n      language: {lang}\n    graders:\n      - type: panel\n    tags:\n      service: other\n      plane: data\n')
    (root / "suites.yaml").write_text(
        "x: 1\nsuites:\n  smoke:\n    evals:\n      - scenarios/identity-python/eval.yaml\n      - 'scenarios/../scenarios/identity-java/eval.yaml'\n    other: 1\n      - ignored\n  empty:\n  bad:\n    evals:\n      - scenarios/none/eval.yaml\nnext: 1\n  late:\n    evals:\n      - z\n"
    )
    return str(root)


@pytest.fixture(scope="module")
def catalog(spark, root):
    return files.catalog(spark, root, [(x, f"experiments/{x}/experiment.yaml") for x in ("python", "java", "typescript", "go")]).cache()


@pytest.fixture(scope="module")
def suites(spark, root):
    return files.suites(spark.read.text(f"{root}/suites.yaml", wholetext=True).select(F.lit("p").alias("path"), "value")).cache()


def picked(catalog, suites, **want):
    return [(r.language, list(r.filters)) for r in group_by_language(select_entries(catalog, suites, Selection(**want))).orderBy("ord").collect()]


def test_scans(catalog, suites, spark, root):
    assert catalog.count() == 5
    sets = catalog.where("language = 'go'").first().tag_sets
    assert sets == [{"service": "tables", "language": "go"}, {"service": "other", "plane": "data"}]
    got = {(r.suite, r.repo_path) for r in suites.collect()}
    assert got == {("smoke", "scenarios/identity-python/eval.yaml"), ("smoke", "scenarios/identity-java/eval.yaml"), ("empty", None), ("bad", "scenarios/none/eval.yaml")}
    # the dimension takes the first service as it stands, quotes included
    assert ("identity-python", '"identity"') in {tuple(r) for r in files.eval_services(spark, root).collect()}


def test_clauses_are_anded_and_values_ored(catalog, suites):
    assert [x for x, _ in picked(catalog, suites, mode="tags", tags="service=identity;language=python")] == ["python"]
    assert [x for x, _ in picked(catalog, suites, mode="tags", tags="language=python,typescript;service=tables")] == ["python", "typescript"]
    # order is declared, not asked for
    assert [x for x, _ in picked(catalog, suites, mode="tags", tags="language=go,java")] == ["java", "go"]


def test_one_tag_set_must_satisfy_all(catalog, suites):
    with pytest.raises(ValueError, match="matched no"):
        picked(catalog, suites, mode="tags", tags="service=identity;plane=data")


def test_suites(catalog, suites):
    assert [x for x, _ in picked(catalog, suites, mode="suite", suite=" smoke ")] == ["python", "java"]
    assert [x for x, _ in picked(catalog, suites, mode="suite", suite="smoke", language="java")] == ["java"]
    with pytest.raises(ValueError, match='Unknown suite "no". Available suites: smoke, empty, bad'):
        picked(catalog, suites, mode="suite", suite="no")
    with pytest.raises(ValueError, match="not declared by a language experiment: scenarios/none/eval.yaml"):
        picked(catalog, suites, mode="suite", suite="bad")


@pytest.mark.parametrize("want,message", [({"mode": "x"}, "Unknown selection mode"), ({"mode": "suite"}, "requires --suite"), ({"mode": "tags"}, "at least one"), ({"mode": "tags", "tags": "service"}, "Invalid tag filter"), ({"mode": "all", "service": ","}, "matched no")])
def test_bad_inputs(catalog, suites, want, message):
    with pytest.raises(ValueError, match=message):
        picked(catalog, suites, **want)


@pytest.mark.parametrize("text", ["=a", "a=", "a", "a=,", ""])
def test_bad_clauses(text):
    with pytest.raises(ValueError):
        parse_tag_filters(text)


def test_matrix(catalog, suites):
    groups = group_by_language(catalog)
    rows = [(r.language, r.variant, r.evaluations) for r in shard_matrix(groups, VARIANTS).orderBy("ord").collect()]
    assert rows[:3] == [("python", "base", 2), ("python", "plus", 2), ("python", "full", 2)] and ("go", "full", 1) not in rows and len(rows) == 11
    with pytest.raises(ValueError, match="do not support"):
        shard_matrix(groups.where("language = 'go'"), VARIANTS, "full")


def test_matrix_text_goes_both_ways(catalog, spark):
    from gradelake.operators.selection import expected_matrix, matrix_json, scenarios

    matrix = shard_matrix(group_by_language(catalog), VARIANTS, "plus")
    back = [tuple(r) for r in expected_matrix(spark, matrix_json(matrix)).orderBy("ord").collect()]
    assert [r[:3] for r in back] == [("python", "plus", 2), ("java", "plus", 1), ("typescript", "plus", 1), ("go", "plus", 1)]
    with pytest.raises(Exception):
        expected_matrix(spark, "{").collect()
    df = spark.createDataFrame([("b", "s", "go"), ("a", "s", "go"), ("c", "t", "go")], "scenario string, service string, language string")
    assert [r.scenario for r in scenarios(df, service="s", language="go").collect()] == ["a", "b"]
    assert [r.scenario for r in scenarios(df, names=["c"]).collect()] == ["c"]


def test_long_files_and_line_ends(spark):
    lines = ["suites:", "  big:", "    evals:", *(f"      - a/{i}.yaml" for i in range(20_000)), "  small:", "    evals:", "      - 'x/./y.yaml'", "end: 1"]
    for sep in ("\n", "\r\n"):
        df = spark.createDataFrame([("p", sep.join(lines))], "path string, value string")
        rows = files.suites(df)
        assert rows.where("suite = 'big'").count() == 20_000 and [r.repo_path for r in rows.where("suite = 'small'").collect()] == ["x/y.yaml"]
        spec = sep.join(["stimuli:", "  - name: a", "    tags:", "      k: v", "      k: 'w'", "    other: 1", "      z: 1"])
        assert spark.createDataFrame([(spec,)], "t string").select(files.tag_sets(F.col("t"))).first()[0] == [{"k": "w"}]
        evals = sep.join(["evals:", "  - a", "  - 'b'", "vary:", "  - c"])
        assert spark.createDataFrame([(evals,)], "t string").select(files.experiment_evals(F.col("t"))).first()[0] == ["a", "b"]
