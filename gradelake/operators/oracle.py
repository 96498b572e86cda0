"""Oracle runs: classify outcomes, validate result rows, and total them by language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.operators.gradetree import nodes, oracle_leaves
from gradelake.operators.ops import running_total
from gradelake.sources.files import BLANK
from gradelake.sources.jsontext import text_of
from gradelake.sources.staging import written

CATEGORIES = (("prompt", "prompt"), ("language", "languageChecks"), ("program", "program"))


def classify(outcomes: DataFrame) -> DataFrame:
    """(id, status, error, prompt, languageChecks, program) from outcomes (id, outcome VARIANT).

    A category has passed, total and the failures as (name, evidence). The status is error if there is one,
    failed if no prompt criterion is there or any check isn't passed; no program check is no failure.
    """
    get = lambda k, t="string": F.try_variant_get("outcome", f"$.{k}", t)
    tree = get("gradeResult", "variant")
    usable = F.coalesce(get("status") == "success", F.lit(False)) & F.coalesce(F.schema_of_variant(tree).like("OBJECT<%"), F.lit(False))
    head = outcomes.select("id", F.when(~usable, F.coalesce(get("error"), F.lit("Oracle did not return a grade result"))).alias("error"), F.when(usable, tree).alias("tree"))
    leaves = oracle_leaves(nodes(head.where("tree is not null")))
    failures = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("number", "name", "evidence")))), lambda x: F.struct(x["name"].alias("name"), x["evidence"].alias("evidence")))
    per = leaves.groupBy("id", "category").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), failures.alias("failures"))
    out = head.drop("tree")
    empty = F.expr("named_struct('passed', 0L, 'total', 0L, 'failures', cast(array() as array<struct<name:string,evidence:string>>))")
    for name, column in CATEGORIES:
        one = per.where(F.col("category") == name).select("id", F.struct("passed", "total", "failures").alias(column))
        out = out.join(one, "id", "left").withColumn(column, F.coalesce(column, empty))
    failed = (F.col("prompt.total") == 0) | F.exists(F.array("prompt", "languageChecks", "program"), lambda c: c["passed"] < c["total"])
    return out.select("id", F.when(F.col("error").isNotNull(), "error").when(failed, "failed").otherwise("passed").alias("status"), "error", *(c for _, c in CATEGORIES))


def _filled(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[^{BLANK}]"), F.lit(False))


def _fields(rows: DataFrame) -> DataFrame:
    """Add the parts of ``row`` that rules look at, each taken from VARIANT once, as columns that begin with an underscore."""
    get = lambda v, path, kind="variant": F.try_variant_get(v, path, kind)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))
    holder = lambda v: get(v, "$", "map<string,variant>").isNotNull() | get(v, "$", "array<variant>").isNotNull()
    names = [n for _, n in CATEGORIES]
    out = rows.select("*", holder("row").alias("_is_object"), *(get("row", f"$.{k}").alias(f"_{k}") for k in ("scenario", "language", "status", "error", *names)))
    texts = [(F.when(kind(F.col(f"_{k}")) == "STRING", get(f"_{k}", "$", "string"))).alias(f"_{k}") for k in ("scenario", "language", "status")]
    error = [F.when(kind(F.col("_error")) == "STRING", get("_error", "$", "string")).alias("_error"), (kind(F.col("_error")) == "VOID").alias("_no_error")]
    parts = [x for n in names for x in (holder(f"_{n}").alias(f"_{n}"), get(f"_{n}", "$.passed").alias(f"_{n}_passed"), get(f"_{n}", "$.total").alias(f"_{n}_total"), get(f"_{n}", "$.failures", "array<variant>").alias(f"_{n}_failures"))]
    out = out.select(*rows.columns, "_is_object", *texts, *error, *parts)

    def whole(c: str) -> Column:
        """The number if it is a whole one that isn't negative, else null."""
        x = get(c, "$", "double")
        return F.when(kind(F.col(c)).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (x == F.floor(x)), x)

    numbers = [whole(f"_{n}_{x}").alias(f"_{n}_{x}") for n in names for x in ("passed", "total")]
    rest = [c for c in out.columns if not c.endswith(("_passed", "_total"))]
    return out.select(*rest, *numbers)


def _bad_failure(x: Column) -> Column:
    return ~(_filled(text_of(x, "$.name")) & text_of(x, "$.evidence").isNotNull())


def _category_rules(name: str) -> list[tuple[Column, Column]]:
    """(test, message) of a category, without the failures one by one."""
    label, there = F.concat("label", F.lit(f".{name}")), F.col(f"_{name}")
    passed, total = F.col(f"_{name}_passed"), F.col(f"_{name}_total")
    wrong = lambda x: there & ~F.coalesce(x >= 0, F.lit(False))
    whole = lambda field: F.concat(label, F.lit(f".{field} must be a non-negative integer"))
    return [
        (~there, F.concat(label, F.lit(" must be an object"))),
        (wrong(passed), whole("passed")),
        (wrong(total), whole("total")),
        (there & F.coalesce(passed > total, F.lit(False)), F.concat(label, F.lit(".passed cannot exceed "), label, F.lit(".total"))),
        (there & F.col(f"_{name}_failures").isNull(), F.concat(label, F.lit(".failures must be an array"))),
    ]


def validate(rows: DataFrame) -> DataFrame:
    """Add n (from 1, in ``ord``) and errors, all messages of a row's rules in order, to (ord, row VARIANT).

    Fields are taken from VARIANT in one projection; messages are made only for rows that break a rule.
    """
    # Numbers over the whole table: the rows of the files before a file are summed first, so that no task orders all rows.
    before = running_total(rows.groupBy(F.col("ord.path").alias("path")).agg(F.count(F.lit(1)).alias("c")), "path", "c").select("path", (F.col("total") - F.col("c")).alias("b"))
    keep = rows.columns
    rows = rows.withColumn("path", F.col("ord.path")).join(before, "path").withColumn("n", F.col("b") + F.col("ord.line")).select(*keep, "n")
    rows = _fields(rows)
    status = F.coalesce("_status", F.lit(""))
    unequal = lambda k: F.coalesce(F.col(f"_{k}_total") == 0, F.lit(False)) | ~F.col(f"_{k}_passed").eqNullSafe(F.col(f"_{k}_total"))
    say = lambda text: F.concat("label", F.lit(text))
    head = [
        (~_filled(F.col("_scenario")), say(" has an invalid scenario")),
        (~_filled(F.col("_language")), say(" has an invalid language")),
        (~status.isin("passed", "failed", "error"), say(" has an invalid status")),
        ((status == "error") & ~_filled(F.col("_error")), say(" error status requires an error message")),
        ((status != "error") & ~F.col("_no_error"), say(" non-error status must have error: null")),
    ]
    tail = [((status == "passed") & (unequal("prompt") | unequal("program")), say(" passed status conflicts with check totals"))]
    groups = [head, *(_category_rules(n) for _, n in CATEGORIES), tail]
    tests = [t for g in groups for t, _ in g] + [F.coalesce(F.exists(f"_{n}_failures", _bad_failure), F.lit(False)) for _, n in CATEGORIES]
    broken = tests[0]
    for t in tests[1:]:
        broken = broken | t
    rows = rows.withColumn("_broken", broken).withColumn("label", F.when(F.col("_broken") | ~F.col("_is_object"), F.concat(F.lit("Result "), F.col("n").cast("string"))))
    parts = []
    for k, g in enumerate(groups):
        parts.append(F.array_compact(F.array(*(F.when(t, m) for t, m in g))))
        if 1 <= k <= len(CATEGORIES):
            name = CATEGORIES[k - 1][1]
            item = lambda x, i: F.when(_bad_failure(x), F.concat("label", F.lit(f".{name}.failures["), i.cast("string"), F.lit("] is invalid")))  # noqa: E731, B023
            parts.append(F.coalesce(F.array_compact(F.transform(f"_{name}_failures", item)), F.expr("cast(array() as array<string>)")))
    errors = F.when(~F.col("_is_object"), F.array(F.concat("label", F.lit(" must be an object")))).when(F.col("_broken"), F.concat(*parts)).otherwise(F.expr("cast(array() as array<string>)"))
    return rows.select(*keep, "n", errors.alias("errors"))


@dataclass
class OracleSummary:
    received: int
    totals: DataFrame
    failures: DataFrame
    integrity: DataFrame


def summarize(rows: DataFrame, expected: int) -> OracleSummary:
    """rows: (ord, row VARIANT). Only rows without errors are totalled; repeated scenarios are, and are reported."""
    spark = rows.sparkSession
    # Written once: totals, failures and problems all read it, and no filter on the errors is worked into their rules.
    checked = written(validate(rows).select("n", "row", "errors"), "checked")
    kind = "struct<passed:bigint,total:bigint,failures:array<struct<name:string,evidence:string>>>"
    pick = [F.variant_get("row", f"$.{k}", "string").alias(k) for k in ("scenario", "language", "status", "error")]
    valid = checked.where("size(errors) = 0").select("n", *pick, *(F.variant_get("row", f"$.{c}", kind).alias(c) for _, c in CATEGORIES))
    sums = [F.sum(f"{c}.{x}").alias(f"{n}_{x}") for n, c in CATEGORIES for x in ("passed", "total")]
    totals = valid.groupBy("language").agg(F.count(F.lit(1)).alias("scenarios"), *sums, F.count_if(F.col("status") == "error").alias("errors"))
    listed = [F.when(F.coalesce("error", F.lit("")) != "", F.array(F.struct(F.lit("infrastructure").alias("category"), F.lit("-").alias("name"), F.col("error").alias("evidence"))))]
    listed += [F.transform(f"{c}.failures", lambda f: F.struct(F.lit(n).alias("category"), f["name"].alias("name"), f["evidence"].alias("evidence"))) for n, c in CATEGORIES]  # noqa: B023
    none = F.expr("cast(array() as array<struct<category:string,name:string,evidence:string>>)")
    failures = valid.select("n", "scenario", F.posexplode(F.concat(*(F.coalesce(x, none) for x in listed))).alias("k", "f")).select("n", "k", "scenario", "f.*")
    received = checked.count()
    bad = checked.select(F.lit(0).alias("part"), "n", F.posexplode("errors").alias("k", "problem"))
    again = valid.withColumn("nth", F.row_number().over(Window.partitionBy("scenario").orderBy("n"))).where("nth > 1").select(F.lit(1).alias("part"), "n", F.lit(0).alias("k"), F.concat(F.lit("Duplicate scenario result: "), "scenario").alias("problem"))
    short = [] if received == expected else [(2, 0, 0, f"Expected {expected} scenario results, received {received}")]
    integrity = bad.union(again).union(spark.createDataFrame(short, "part int, n bigint, k int, problem string"))
    return OracleSummary(received, totals, failures, integrity)


def language_matrix(scenarios: DataFrame) -> DataFrame:
    """(language, evaluations) of scenarios, in locale order."""
    return scenarios.groupBy("language").agg(F.count(F.lit(1)).alias("evaluations")).orderBy(F.expr("language COLLATE UNICODE"))
