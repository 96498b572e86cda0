"""Markdown reports. Totals are small (groups, not trials); of failures and problems a stated number is listed, with the count of all."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from gradelake.functions.scalars import markdown_cell, percentage
from gradelake.operators.fanin import FanIn
from gradelake.operators.ops import in_ranges
from gradelake.operators.oracle import OracleSummary


#: Headings, table heads and sentences of the reports.
VARIANT_HEAD = ["## Variant totals", "", "| Variant | Trials | Prompt | Language | Program |", "|---|---:|---:|---:|---:|"]
SERVICE_HEAD = ["## Service totals", "", "| Service | Variant | Trials | Prompt | Language | Program |", "|---|---|---:|---:|---:|---:|"]
SHARD_HEAD = ["## Shards", "", "| Language | Variant | Trials | Prompt | Language | Program |", "|---|---|---:|---:|---:|---:|"]
ORACLE_HEAD = ["| Language | Scenarios | Prompt | Language | Program | Errors |", "|---|---:|---:|---:|---:|---:|"]
FAILURE_HEAD = ["| Scenario | Category | Check | Evidence |", "|---|---|---|---|"]
COMPLETED = "Completed {} trial(s) across {}/{} shard(s)."
COLLECTED = "Collected {}/{} scenario result(s)."
FAILURES, INTEGRITY, NO_FAILURES = "## Check and infrastructure failures", "## Integrity", "None."
ALL_COLLECTED = "All expected shards and trial results were collected without integrity errors."
ALL_ORACLES = "All expected oracle results were collected."
#: Problems and failures that a report lists; it states how many more there are.
MOST_LISTED = 10_000


def _listed(df, *order: str) -> list:
    """The first rows in order, by a top-k."""
    return df.orderBy(*order).limit(MOST_LISTED).collect()


def _more(n: int, df, what: str) -> list[str]:
    rest = df.count() - n if n >= MOST_LISTED else 0
    return [f"and {rest} more {what}"] if rest else []


def _cell(kind: str):
    p, t = F.col(f"{kind}_passed"), F.col(f"{kind}_total")
    return F.concat(p.cast("string"), F.lit("/"), t.cast("string"), F.lit(" ("), percentage(p, t), F.lit(")"))


def _rows(df, *cells):
    return [r[0] for r in df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))).toLocalIterator()]


def fan_in_report(result: FanIn, order, title: str = "# Evaluation summary") -> tuple[str, list[str]]:
    """(markdown, problems). order: the expected matrix (language, variant, evaluations, ord), in its order."""
    t = result.totals.cache()
    cells = [_cell(k) for k in ("prompt", "language", "program")]
    none = [F.lit("n/a")] * 3
    pick = lambda: [F.when(F.col("trials").isNull(), n).otherwise(c) for c, n in zip(cells, none)]
    trials = F.coalesce("trials", F.lit(0)).cast("string")
    variants = order.groupBy("variant").agg(F.min("ord").alias("ord"))
    shards = order.join(result.shards.select("language", "variant").distinct().withColumn("there", F.lit(1)), ["language", "variant"], "left")
    done = result.trials.count()
    n_shards, n_expected = result.shards.count(), result.expected.count()
    lines = [title, "", COMPLETED.format(done, n_shards, n_expected), "", *VARIANT_HEAD]
    lines += _rows(variants.join(t.where("level = 'variant'").drop("language", "service"), "variant", "left").orderBy("ord"), "variant", trials, *pick())
    lines += ["", *SERVICE_HEAD]
    lines += _rows(t.where("level = 'service'").orderBy(F.expr("service COLLATE UNICODE"), F.expr("variant COLLATE UNICODE")), "service", "variant", trials, *pick())
    lines += ["", *SHARD_HEAD]
    lines += _rows(shards.join(t.where("level = 'shard'").drop("service"), ["language", "variant"], "left").orderBy("ord"), "language", "variant", F.concat(trials, F.lit("/"), F.col("evaluations").cast("string")), *pick())
    problems = [r["problem"] for r in _listed(result.problems, "ord")]
    problems += _more(len(problems), result.problems, "problems")
    lines += ["", INTEGRITY, ""]
    lines += [f"- {p}" for p in problems] or [ALL_COLLECTED]
    t.unpersist()
    return "\n".join([*lines, ""]), problems


def oracle_report(result: OracleSummary, expected: int, title: str = "# Oracle summary") -> tuple[str, list[str]]:
    lines = [title, "", COLLECTED.format(result.received, expected), "", *ORACLE_HEAD]
    lines += _rows(result.totals.orderBy(F.expr("language COLLATE UNICODE")), "language", F.col("scenarios").cast("string"), *(_cell(k) for k in ("prompt", "language", "program")), F.col("errors").cast("string"))
    lines += ["", FAILURES, ""]
    failed = _rows(result.failures.orderBy("n", "k").limit(MOST_LISTED), "scenario", "category", "name", markdown_cell("evidence"))
    lines += [*FAILURE_HEAD, *failed, *_more(len(failed), result.failures, "failures")] if failed else [NO_FAILURES]
    integrity = [r["problem"] for r in _listed(result.integrity, "part", "n", "k")]
    integrity += _more(len(integrity), result.integrity, "problems")
    lines += ["", INTEGRITY, "", *([f"- {x}" for x in integrity] or [ALL_ORACLES])]
    return "\n".join(lines) + "\n", integrity


def every_line(rows, *order: str, line: str = "problem") -> Iterator[str]:
    """All lines of a list, however many: a range of the order at a time comes to the driver."""
    for r in in_ranges(rows.select(*order, line), *order).orderBy("_part", "_place").select(line).toLocalIterator():
        yield r[0]


def write_report(markdown: str, problems: list[str], path: str | None = None, every: Iterator[str] | None = None) -> int:
    """Print the report, write it if a path is given, and return the exit status. With ``every``, the file lists all problems in place of the first."""
    if path:
        with open(path, "w", encoding="utf-8") as f:
            if every is None or not problems:
                f.write(markdown)
            else:
                f.write(markdown.rpartition(f"{INTEGRITY}\n\n")[0] + f"{INTEGRITY}\n\n")
                f.writelines(f"- {x}\n" for x in every)
    print(markdown)
    return int(bool(problems))
