"""Fan-in of shard results: reconcile expected with observed, check every trial, and total pass counts.

Each step is a DataFrame over trials; nothing but the finished report reaches the driver. Problems carry a
sort key (stage, shard, row, rule, index), so that the report lists them in reading order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.functions.scalars import criterion_kind
from gradelake.sources import files
from gradelake.sources.staging import written

#: The program checks that each language must report.
REQUIRED_CHECKS = {
    "dotnet": ("program/dotnet-project-builds",),
    "go": ("program/go-project-tests",),
    "java": ("program/java-project-compiles",),
    "python": ("program/python-source-compiles",),
    "typescript": ("program/typescript-dependencies-install", "program/typescript-type-checks"),
}


def _problem(df: DataFrame, stage: int, message, shard="''", row="''", rule: int = 0, idx="0") -> DataFrame:
    key = F.expr(f"named_struct('stage', {stage}, 'shard', {shard}, 'row', {row}, 'rule', {rule}, 'idx', cast({idx} as int))")
    return df.select(key.alias("ord"), message.alias("problem"))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Add ``nth``: 1 for the first row of each key in the order, 2 and on for its repeats."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def required_checks(spark: SparkSession, required: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(lang, k, name) for lang, names in required.items() for k, name in enumerate(names)]
    return spark.createDataFrame(rows, "language string, idx int, name string")


def check_counts(trials: DataFrame, required: DataFrame) -> DataFrame:
    """One row per (trial, required or reported check): id, language, idx, name, needed, seen, passed.

    trials: id, language, programs. A check counts as passed only if it is required and reported exactly once.
    """
    want = trials.select("id", "language").join(F.broadcast(required), "language").select("id", "idx", "name")  # a few rows per language
    seen = trials.select("id", F.posexplode("programs").alias("p", "c")).groupBy("id", F.col("c.name").alias("name")).agg(F.count(F.lit(1)).alias("seen"), F.bool_and(F.coalesce("c.passed", F.lit(False))).alias("ok"), F.min("p").alias("p"))
    both = want.join(seen, ["id", "name"], "full_outer")
    needed = F.col("idx").isNotNull()
    n = F.coalesce("seen", F.lit(0))
    return both.select("id", "name", F.coalesce("idx", "p").alias("idx"), needed.alias("needed"), n.alias("seen"), (needed & (n == 1) & F.coalesce("ok", F.lit(False))).alias("passed"))


def trial_counts(trials: DataFrame, checks: DataFrame) -> DataFrame:
    """Add to each trial its passed and total numbers by criterion kind and of program checks."""
    kinds = trials.select("*", F.transform("criteria", lambda c: F.struct(criterion_kind(c["name"]).alias("kind"), F.coalesce(c["passed"], F.lit(False)).alias("ok"))).alias("_k"))
    for kind in ("prompt", "language", "other"):
        mine = F.filter("_k", lambda k: k["kind"] == kind)  # noqa: B023
        kinds = kinds.withColumn(f"{kind}_total", F.size(mine).cast("long")).withColumn(f"{kind}_passed", F.size(F.filter(mine, lambda k: k["ok"])).cast("long"))
    programs = checks.where("needed").groupBy("id").agg(F.count(F.lit(1)).alias("program_total"), F.count_if("passed").alias("program_passed"))
    return kinds.drop("_k").join(programs, "id", "left").fillna(0, ["program_total", "program_passed"])


COUNTS = [f"{k}_{x}" for k in ("prompt", "language", "other", "program") for x in ("passed", "total")]


def totals(counted: DataFrame) -> DataFrame:
    """Sums by (language, variant), (variant) and (service, variant) in one pass; level names the grouping."""
    sums = ", ".join(f"sum({c}) AS {c}" for c in COUNTS)
    level = "CASE WHEN grouping(language) = 0 THEN 'shard' WHEN grouping(service) = 0 THEN 'service' ELSE 'variant' END"
    return counted.sparkSession.sql(
        f"SELECT {level} AS level, language, service, variant, count(*) AS trials, {sums} FROM {{t}} GROUP BY GROUPING SETS ((language, variant), (variant), (service, variant))",
        t=counted.select("language", "service", "variant", *COUNTS),
    )


@dataclass
class FanIn:
    expected: DataFrame
    shards: DataFrame
    trials: DataFrame
    totals: DataFrame
    problems: DataFrame


def fan_in(spark: SparkSession, root: str, expected: DataFrame, services: DataFrame, required: dict[str, tuple[str, ...]] = REQUIRED_CHECKS, results: str = "results.jsonl", manifest: str = "evaluation-shard.json") -> FanIn:
    """expected: language, variant, evaluations, ord; services: eval_name, service. The texts of problems are fixed values.

    Repeats follow path order: of manifests of one shard, and of results of one (variant, eval_name) over all
    shards, the first by path and line counts. A result belongs to the language of its manifest and keeps
    its own variant. A manifest's results are all result files at any depth under its folder.
    """
    expected = expected.withColumn("nth", F.row_number().over(Window.partitionBy("language", "variant").orderBy(F.col("ord").desc()))).where("nth = 1").drop("nth", "ord")
    all_shards = first_wins(files.manifests(spark, root, manifest), ["language", "variant"], ["path"])
    key = F.concat_ws("/", "language", "variant")
    shards = all_shards.where("nth = 1").drop("nth")
    paired = expected.join(shards, ["language", "variant"], "full_outer").withColumn("key", key)

    found = files.found_paths(spark, root, results)
    # A file belongs to the manifests of any folder above it: its folders meet theirs in an equi-join, before lines are read.
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    owners = found.select(F.col("path").alias("file")).withColumn("dir", F.explode(above)).join(shards.withColumnRenamed("variant", "shard_variant"), "dir").drop("dir")
    parsed = files.trials(files.numbered_lines(spark, root, results).withColumnRenamed("path", "file"))
    owned = parsed.join(owners, "file").withColumn("key", F.concat_ws("/", "language", "shard_variant"))
    # Parsed once: counts, totals and problems all read this table.
    owned = written(owned.withColumn("row", F.format_string("%s %010d", "file", "line")), "trials")
    good = owned.where("message is null")
    counts = good.groupBy("key").agg(F.count(F.lit(1)).alias("found"))
    ranked = first_wins(good, ["variant", "eval_name"], ["path", "file", "line"])
    rows = ranked.where("nth = 1").drop("nth").withColumn("id", F.struct("path", "file", "line"))
    rows = rows.withColumnRenamed("service", "own").join(services, "eval_name", "left").withColumn("known", F.coalesce("own", "service")).withColumn("service", F.coalesce("own", "service", F.lit("unknown")))
    rows = written(rows, "rows")
    checks = written(check_counts(rows, required_checks(spark, required)), "checks")
    counted = trial_counts(rows, checks)

    name = F.concat_ws("/", "variant", "eval_name")
    text = lambda *xs: F.concat(*(F.lit(x) if i % 2 == 0 else F.col(x).cast("string") if isinstance(x, str) else x for i, x in enumerate(xs)))
    has = F.col("evaluations").isNotNull()
    counted_shards = paired.where("path is not null").join(counts, "key", "left").withColumn("n", F.coalesce("found", F.lit(0)))
    by_row = checks.join(rows.select("id", "path", "row", "variant", "eval_name"), "id").withColumn("check", F.concat_ws("/", "variant", "eval_name", "name"))
    errors = rows.select("path", "row", "variant", "eval_name", F.posexplode("programs").alias("p", "c")).where("c.error")
    p = [
        _problem(all_shards.where("nth > 1").withColumn("key", key), 0, text("Duplicate shard manifest: ", "key"), "path"),
        _problem(paired.where("path is null"), 1, text("Missing shard artifact: ", "key"), "key"),
        _problem(paired.where(~has), 2, text("Unexpected shard artifact: ", "key"), "path"),
        _problem(owned.where("message is not null"), 3, text("Malformed result in ", "key", " (", F.regexp_extract("file", "([^/]*)$", 1), ":", "line", "): ", "message"), "path", "row", 0),
        _problem(counted_shards.where(has & ~F.col("expected").eqNullSafe(F.col("evaluations"))), 3, text("Manifest count mismatch in ", "key", ": expected ", "evaluations", ", manifest reports ", F.coalesce(F.col("expected").cast("string"), F.lit("undefined"))), "path", "''", 1),
        _problem(counted_shards.where(has & (F.col("n") != F.col("evaluations"))), 3, text("Incomplete shard ", "key", ": expected ", "evaluations", " result(s), found ", "n"), "path", "''", 2),
        _problem(ranked.where("nth > 1").withColumn("name", name), 3, text("Duplicate result: ", "name"), "path", "row", 3),
        _problem(rows.where("variant <> shard_variant"), 3, text("Variant mismatch in ", "key", ": result ", "eval_name", " reports ", "variant"), "path", "row", 4),
        _problem(rows.where("status <> 'success'"), 3, text("Unsuccessful trial in ", "key", ": ", "eval_name", " has status ", "status"), "path", "row", 5),
        _problem(rows.where("known is null"), 4, text("Service tag not found for ", "eval_name"), "path", "row", 0),
        _problem(rows.where("size(criteria) = 0").withColumn("name", name), 4, text("No criterion results found: ", "name"), "path", "row", 1),
        _problem(rows.where("size(programs) = 0").withColumn("name", name), 4, text("No program check results found: ", "name"), "path", "row", 2),
        _problem(by_row.where("needed and seen = 0"), 4, text("Missing program check: ", "check"), "path", "row", 3, "idx"),
        _problem(by_row.where("needed and seen > 1"), 4, text("Duplicate program check: ", "check"), "path", "row", 3, "idx"),
        _problem(by_row.where("not needed"), 4, text("Unexpected program check: ", "check"), "path", "row", 4, "idx"),
        _problem(errors.withColumn("check", F.concat_ws("/", "variant", "eval_name", "c.name")), 4, text("Program check error: ", "check"), "path", "row", 5, "p"),
    ]
    # Malformed lines come first within a shard, then its counts, then its rows.
    rank = lambda df: df.withColumn("ord", F.struct(F.col("ord.stage").alias("stage"), F.col("ord.shard").alias("shard"), F.when((F.col("ord.stage") == 3) & (F.col("ord.rule") < 3), F.col("ord.rule")).otherwise(3).alias("part"), F.col("ord.row").alias("row"), F.col("ord.rule").alias("rule"), F.col("ord.idx").alias("idx")))
    problems = rank(p[0])
    for x in p[1:]:
        problems = problems.unionByName(rank(x))
    return FanIn(expected, shards, counted, totals(counted), problems)
