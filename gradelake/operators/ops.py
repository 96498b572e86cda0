"""Small relational operators: pages, chunks, bounded batches, first and last rows, runs, positions, matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.sources.staging import written

#: Rows that one range of an order holds at most, about, and those that are worth a range of their own; the number of ranges follows the number of rows.
RANGE, SMALL_RANGE = 1 << 20, 1 << 14


def keyset_page(df: DataFrame, key: str, size: int, after=None) -> DataFrame:
    """The ``size`` rows that follow the key ``after``, in key order: a top-k, never an offset."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size)


def next_token(page: DataFrame, key: str):
    """What to ask the following page with; None after the last row."""
    return page.agg(F.max(key)).first()[0]


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows, written, with ``_part`` and ``_place``: ranges of the order in ascending number, and places from 0 inside them.

    Spark's range partitioning cuts the order at values of a sample, which decides only how even the ranges are. They
    are as many as the rows need, and at least as many as a shuffle has tasks.
    """
    n = df.count()
    ranges = max(-(-n // RANGE), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // SMALL_RANGE)), 1)
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return written(dealt.withColumn("_part", part).withColumn("_place", place).drop("_id"), "ranges")


def _shifts(ranged: DataFrame, amount: Column, name: str) -> DataFrame:
    """(_part, name): what the ranges before each sum up to; a row for each range."""
    per = ranged.groupBy("_part").agg(amount.alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(per.select("_part", before.alias(name)))


def global_rank(df: DataFrame, key: str) -> DataFrame:
    """Add ``rank`` from 0 in the order of a unique key, nulls first, without bringing all rows to one task."""
    ranged = in_ranges(df, key)
    return ranged.join(_shifts(ranged, F.count(F.lit(1)), "_b"), "_part").withColumn("rank", F.col("_b") + F.col("_place")).drop("_part", "_place", "_b")


def starting_ranks(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``in_ranges`` (ordered by keys first) with ``_nth``, places from 0 inside each key, in place of the numbers of ranges."""
    numbered = ranged.join(_shifts(ranged, F.count(F.lit(1)), "_b"), "_part").withColumn("_nth", F.col("_b") + F.col("_place")).drop("_part", "_place", "_b")
    begin = numbered.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min("_nth").alias("_first"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & numbered[k].eqNullSafe(F.col(f"_k{i}"))
    return numbered.join(begin, same).withColumn("_nth", F.col("_nth") - F.col("_first")).drop("_first", *(f"_k{i}" for i in range(len(keys))))


def running_total(df: DataFrame, key: str, amount: str) -> DataFrame:
    """Add ``total``, the sum of ``amount`` up to and with each row in the order of a unique key."""
    ranged = in_ranges(df, key)
    inside = F.sum(amount).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(_shifts(ranged, F.sum(amount), "_b"), "_part").withColumn("total", F.col("_b") + inside).drop("_part", "_place", "_b")


def chunks(df: DataFrame, key: str, size: int = 256) -> DataFrame:
    """Add ``chunk``: consecutive rows by key, ``size`` to a chunk."""
    return global_rank(df, key).withColumn("chunk", F.floor(F.col("rank") / size)).drop("rank")


def first_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row of each key: an aggregate that combines before the shuffle, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def last_by(df: DataFrame, keys: list[str], order: Column, place: str = "first_seen") -> DataFrame:
    """The last row of each key, with the order of its first appearance."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias(place))
    return rows.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest), place)


def consecutive_failures(df: DataFrame, keys: list[str], order: str, failed: Column, threshold: int = 3) -> DataFrame:
    """Add ``streak``, failures in a row up to this one, and ``open``, true from the threshold on; a success resets."""
    w = Window.partitionBy(*keys).orderBy(order)
    f = F.coalesce(failed, F.lit(False))
    runs = df.withColumn("_f", f).withColumn("_run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_run").orderBy(order)
    streak = F.sum(F.col("_f").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("streak", streak).withColumn("open", F.col("streak") >= threshold).drop("_f", "_run")


def assistant_texts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv, turn, pos, text): the texts that the assistant gave, in order; ``parts`` is a text or an array of texts, null ones are left out."""
    listed = F.col(parts) if turns.schema[parts].dataType.typeName() == "array" else F.array(parts)
    rows = turns.where(F.col(role) == "assistant").select(conv, turn, F.posexplode(listed).alias("pos", "text"))
    return rows.where("text is not null").orderBy(conv, turn, "pos")


def any_running(operations: DataFrame, keys: list[str], running: Column) -> DataFrame:
    """(keys, running): whether one of a key's operations runs now; a state that is null doesn't."""
    return operations.groupBy(*keys).agg(F.bool_or(F.coalesce(running, F.lit(False))).alias("running"))


def total_charge(pages: DataFrame, keys: list[str], charge: Column, kind: str = "decimal(38,2)") -> DataFrame:
    """(keys, pages, charge): the charges of all pages of a query, summed exactly."""
    return pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"), F.sum(charge.cast(kind)).alias("charge"))


def broken_invariants(rows: DataFrame, keys: list[str], expected: dict[str, tuple[Column, int | None, int | None]]) -> DataFrame:
    """(keys, rule, found) of keys whose number of rows that meet a rule's test is below its low or above its high bound."""
    counts = rows.groupBy(*keys).agg(*(F.count_if(test).alias(f"_{i}") for i, (test, _, _) in enumerate(expected.values())))
    listed = F.array(*(F.struct(F.lit(rule).alias("rule"), F.col(f"_{i}").alias("found"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high")) for i, (rule, (_, low, high)) in enumerate(expected.items())))
    out = counts.select(*keys, F.explode(listed).alias("x")).where("x.found < x.low or x.found > x.high")
    return out.select(*keys, "x.rule", "x.found")


def zip_by_position(left: Column, right: Column) -> Column:
    """Pairs of two arrays by place; the shorter is filled with nulls."""
    return F.arrays_zip(left.alias("left"), right.alias("right"))


def changed_settings(cached: DataFrame, fresh: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Fresh rows that are new or differ in a value; nulls are equal to nulls."""
    old = cached.select(*keys, *(F.col(v).alias(f"_old_{v}") for v in values), F.lit(True).alias("_known"))
    same = F.col("_known")
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    return fresh.join(old, keys, "left").where(~F.coalesce(same, F.lit(False))).select(*fresh.columns)


def any_changed(cached: DataFrame, fresh: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: whether a sentinel changed."""
    return changed_settings(cached, fresh, keys, values).agg((F.count(F.lit(1)) > 0).alias("changed"))


def expiring(df: DataFrame, expires: str, window: str, now: Column | None = None) -> DataFrame:
    now = F.current_timestamp() if now is None else now
    return df.where(F.col(expires).isNotNull() & (F.col(expires) <= now + F.expr(f"INTERVAL {window}")))


def parameter_filter(df: DataFrame, column: str, value) -> DataFrame:
    """Equality with a bound parameter: the value is never part of the query text."""
    return df.sparkSession.sql(f"SELECT * FROM {{t}} AS c WHERE c.`{column}` = :value", args={"value": value}, t=df)


def prefixed(df: DataFrame, key: str, prefix: str, label: Column | None = None) -> DataFrame:
    rows = df.where(F.col(key).startswith(prefix))
    return rows if label is None else rows.where(label)


def route(amount: str, over: float = 1000.0, delay: str = "30 SECONDS", now: Column | None = None) -> list[Column]:
    """Columns priority and deliver_at: large orders are high and delayed."""
    large = F.col(amount) > over
    start = F.current_timestamp() if now is None else now
    return [F.when(large, "high").otherwise("normal").alias("priority"), F.when(large, start + F.expr(f"INTERVAL {delay}")).alias("deliver_at")]


def enabled_label(enabled: str) -> Column:
    """Only false is disabled; null counts as enabled."""
    return F.when(F.col(enabled) == F.lit(False), "disabled").otherwise("enabled")


def dispatch_checked(name: str, arguments: Column, allowed: dict[str, Callable[[Column], Column]]) -> Column:
    """The arguments of an allowed call whose domain test holds; anything else is an error."""
    out = F.raise_error(F.concat(F.lit("Unknown function: "), F.coalesce(F.col(name), F.lit("")))).cast("string")
    for k, test in allowed.items():
        checked = F.when(test(arguments), arguments.cast("string")).otherwise(F.raise_error(F.lit(f"Invalid arguments for {k}")).cast("string"))
        out = F.when(F.col(name) == k, checked).otherwise(out)
    return out


def citations(responses: DataFrame, id_col: str = "id", body: str = "body") -> DataFrame:
    """(id, pos, kind, file_id, text) from VARIANT responses: texts of messages, their file citations, and file search results."""
    get = lambda v, k, t="string": F.try_variant_get(v, f"$.{k}", t)

    def spread(df: DataFrame, variant, *keep) -> DataFrame:
        listed = F.when(F.schema_of_variant(variant).like("ARRAY<%"), F.try_variant_get(variant, "$", "array<variant>"))
        return df.select(*keep, F.posexplode(listed).alias("p", "x"))

    items = spread(responses, get(F.col(body), "output", "variant"), F.col(id_col).alias("id")).select("id", F.col("p").alias("p0"), F.col("x").alias("item"))
    searched = spread(items.where(get(F.col("item"), "type") == "file_search_call"), get(F.col("item"), "results", "variant"), "id", "p0")
    found = searched.select("id", F.array("p0", "p", F.lit(0)).alias("pos"), F.lit("result").alias("kind"), get(F.col("x"), "file_id").alias("file_id"), get(F.col("x"), "text").alias("text"))
    parts = spread(items.where(get(F.col("item"), "type") == "message"), get(F.col("item"), "content", "variant"), "id", "p0").where(get(F.col("x"), "type") == "output_text").select("id", "p0", F.col("p").alias("p1"), F.col("x").alias("part"))
    texts = parts.select("id", F.array("p0", "p1", F.lit(-1)).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("file_id"), get(F.col("part"), "text").alias("text"))
    cited = spread(parts, get(F.col("part"), "annotations", "variant"), "id", "p0", "p1").where(get(F.col("x"), "type") == "file_citation")
    cites = cited.select("id", F.array("p0", "p1", "p").alias("pos"), F.lit("citation").alias("kind"), get(F.col("x"), "file_id").alias("file_id"), F.lit(None).cast("string").alias("text"))
    return texts.union(cites).union(found)


def accepted_feedback(feedback: DataFrame, answers: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): feedback on an answer that is there, and the rest."""
    known = answers.select(*keys)
    return feedback.join(known, keys, "left_semi"), feedback.join(known, keys, "left_anti")


def new_ids(before: Column, after: Column) -> Column:
    return F.array_sort(F.array_except(after, before))


def locale_sorted(df: DataFrame, *columns: str) -> DataFrame:
    return df.orderBy(*(F.expr(f"`{c}` COLLATE UNICODE") for c in columns))


def token_f1(response: Column, truth: Column) -> Column:
    """An extension: harmonic mean of precision and recall over words with multiplicity."""
    words = lambda x: F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    a, b = words(response), words(truth)
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def upsert_versions(current: DataFrame, changes: DataFrame, key: str, version: str = "version") -> DataFrame:
    """Compare and set: a change applies if its version is the stored one (or the row is new), and raises it by one."""
    rest = [c for c in current.columns if c not in (key, version)]
    new = changes.select(key, F.col(version).alias("_v"), *(F.col(c).alias(f"_n_{c}") for c in rest), F.lit(True).alias("_there"))
    both = current.withColumn("_here", F.lit(True)).join(new, key, "full_outer")
    here, there = F.coalesce("_here", F.lit(False)), F.coalesce("_there", F.lit(False))
    takes = there & (~here | F.col("_v").eqNullSafe(F.col(version)))
    raised = F.when(takes, F.coalesce(F.col(version), F.lit(0)) + 1).otherwise(F.col(version)).alias(version)
    return both.select(key, raised, *(F.when(takes, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in rest), (there & ~takes).alias("conflict"))


def of_kind(df: DataFrame, discriminator: str, kind: str) -> DataFrame:
    return df.where(F.col(discriminator) == kind)


def refreshed(cached: DataFrame, fresh: DataFrame, sentinels: Column, keys: list[str], values: list[str]) -> DataFrame:
    """All fresh settings if one of the sentinels is new or changed, else the cached ones."""
    moved = not changed_settings(cached.where(sentinels), fresh.where(sentinels), keys, values).isEmpty()
    return fresh if moved else cached
