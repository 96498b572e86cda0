"""Selecting evaluations: tag predicates, suites and the shard matrix.

A catalog is a DataFrame (ord, language, experiment, filter, repo_path, tag_sets array<map<string,string>>);
suites are (suite, ord, repo_path). Filters are small driver-side lists that become one predicate.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TagFilter:
    key: str
    values: tuple[str, ...]


def _split(text: str, sep: str) -> list[str]:
    return [x for x in (p.strip() for p in text.split(sep)) if x]


def parse_tag_filters(text: str | None) -> list[TagFilter]:
    """``key=a,b;key2=c``: AND over clauses, OR within one."""
    if not (text or "").strip():
        raise ValueError("Tag selection requires at least one key=value filter.")
    out = []
    for clause in _split(text, ";"):
        key, sep, values = clause.partition("=")
        if not (key and sep and values):
            raise ValueError(f'Invalid tag filter "{clause}". Use key=value1,value2 and separate filters with semicolons.')
        if not key.strip() or not _split(values, ","):
            raise ValueError(f'Invalid tag filter "{clause}".')
        out.append(TagFilter(key.strip(), tuple(_split(values, ","))))
    return out


@dataclass(frozen=True)
class Selection:
    mode: str = "all"
    suite: str | None = None
    tags: str | None = None
    language: str | None = None
    service: str | None = None
    plane: str | None = None
    scope: str | None = None

    def filters(self) -> list[TagFilter]:
        """A value of nothing but commas and blanks is a filter that matches nothing."""
        named = [TagFilter(k, tuple(_split(v, ","))) for k in ("language", "service", "plane", "scope") if (v := getattr(self, k) or "").strip()]
        return named + (parse_tag_filters(self.tags) if (self.tags or "").strip() else [])


def matches_all(tags: Column, filters: list[TagFilter]) -> Column:
    out = F.lit(True)
    for f in filters:
        out = out & (F.coalesce(F.try_element_at(tags, F.lit(f.key)).isin(*f.values), F.lit(False)) if f.values else F.lit(False))
    return out


def any_set_matches(tag_sets, filters: list[TagFilter]) -> Column:
    """True if one tag set satisfies every clause."""
    return F.exists(tag_sets, lambda t: matches_all(t, filters))


#: Names that a message lists; it states how many more there are.
MOST_NAMED = 1000


def _named(rows: DataFrame, order: str, column: str) -> str:
    first = [r[0] for r in rows.orderBy(order).limit(MOST_NAMED).select(column).collect()]
    more = rows.count() - len(first) if len(first) == MOST_NAMED else 0
    return ", ".join(first) + (f" and {more} more" if more else "")


def select_entries(catalog: DataFrame, suites: DataFrame | None, want: Selection) -> DataFrame:
    """Entries of the catalog that the selection names; errors as an empty or unknown selection needs them."""
    if want.mode not in ("all", "suite", "tags"):
        raise ValueError(f'Unknown selection mode "{want.mode}".')
    if want.mode == "suite" and not (want.suite or "").strip():
        raise ValueError("Suite selection requires --suite <name>.")
    out = catalog
    if (want.suite or "").strip():
        name = want.suite.strip()
        paths = suites.where(F.col("suite") == name)
        if paths.isEmpty():
            known = _named(suites.groupBy("suite").agg(F.min("suite_ord").alias("o")), "o", "suite")
            raise ValueError(f'Unknown suite "{name}". Available suites: {known}')
        paths = paths.where("repo_path is not null")
        missing = _named(paths.join(catalog, "repo_path", "left_anti"), "ord", "repo_path")
        if missing:
            raise ValueError(f'Suite "{name}" contains evaluations not declared by a language experiment: {missing}')
        out = out.join(paths.select("repo_path"), "repo_path", "left_semi")
    filters = want.filters()
    if want.mode == "tags" and not filters:
        raise ValueError("Tag selection requires at least one key=value filter.")
    if filters:
        out = out.where(any_set_matches("tag_sets", filters))
    if out.isEmpty():
        raise ValueError("The requested selection matched no experiment evaluations.")
    return out


def group_by_language(entries: DataFrame) -> DataFrame:
    """(language, experiment, filters, ord): the filters of each language in catalog order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "filter")))
    return entries.groupBy("language", "experiment").agg(F.min("ord").alias("ord"), F.transform(rows, lambda x: x["filter"]).alias("filters"))


def total_evaluations(groups: DataFrame) -> DataFrame:
    """One row: how many evaluations the groups of ``group_by_language`` have together."""
    return groups.agg(F.coalesce(F.sum(F.size("filters").cast("long")), F.lit(0)).alias("evaluations"))


@dataclass(frozen=True)
class Variants:
    """Run variants in order, and the only ones of some languages."""

    names: tuple[str, ...]
    only: dict[str, tuple[str, ...]] = field(default_factory=dict)


def shard_matrix(groups: DataFrame, variants: Variants, variant: str = "all") -> DataFrame:
    """(language, variant, evaluations, ord) for each group and each variant it supports."""
    spark = groups.sparkSession
    names = variants.names if variant == "all" else (variant,)
    wanted = spark.createDataFrame(list(enumerate(names)), "variant_ord int, variant string")
    refused = [(lang, v) for lang, only in variants.only.items() for v in names if v not in only]
    out = groups.select("language", F.size("filters").cast("long").alias("evaluations"), "ord").crossJoin(F.broadcast(wanted))  # a handful of variants
    if refused:
        out = out.join(F.broadcast(spark.createDataFrame(refused, "language string, variant string")), ["language", "variant"], "left_anti")
    if variant != "all" and variant not in variants.names:
        out = out.where(F.col("language").isin(*[k for k, only in variants.only.items() if variant in only]))
    if out.isEmpty():
        raise ValueError("The selected evaluations do not support the requested variant.")
    return out.select("language", "variant", "evaluations", F.struct("ord", "variant_ord").alias("ord"))


def matches_columns(filters: list[TagFilter]) -> Column:
    """The same AND of ORs over plain columns, in a form that is pushed down to the scan."""
    out = F.lit(True)
    for f in filters:
        out = out & (F.coalesce(F.col(f.key).isin(*f.values), F.lit(False)) if f.values else F.lit(False))
    return out


def scenarios(services: DataFrame, names: list[str] | None = None, service: str | None = None, language: str | None = None) -> DataFrame:
    """(scenario, service, language) rows of a selector: all, some names, or one service; and one language if given. In name order."""
    out = services
    if names is not None:
        out = out.where(F.col("scenario").isin(*names))
    if service is not None:
        out = out.where(F.col("service") == service)
    if language is not None:
        out = out.where(F.col("language") == language)
    return out.orderBy(F.expr("scenario COLLATE UNICODE"))


def matrix_json(matrix: DataFrame) -> str:
    """{"include": [...]} of a shard matrix in its order, for the tools that start the shards."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", "language", "variant", "evaluations"))), lambda x: F.struct(x["language"].alias("language"), x["variant"].alias("variant"), x["evaluations"].alias("evaluations")))
    return matrix.agg(F.to_json(F.struct(rows.alias("include"))).alias("j")).first().j


def expected_matrix(spark, text: str) -> DataFrame:
    """The inverse: (language, variant, evaluations, ord) from such a text; bad JSON is an error."""
    kind = "include array<struct<language:string,variant:string,evaluations:bigint>>"
    one = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", kind, {"mode": "FAILFAST"}).alias("m"))
    return one.select(F.posexplode("m.include").alias("ord", "x")).select("x.language", "x.variant", "x.evaluations", "ord")
