"""Folds over sorted rows that are sequential by meaning, done in parallel on keys of any size.

Rows are cut into ranges of (key, order). What a range does to the state it is given is a function of that state, and
a short table: for states from ``lo`` to ``hi`` the state after it is base + keep * state, and the number after it
nbase + nkeep * number. Such tables compose: two neighbours become one table, two of these one again, up to
one for all rows; on the way back down each range learns the state it begins with. Then all ranges run the fold at
once. Each step is a written table of a few rows a range; a key of any size is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradelake.operators.ops import in_ranges
from gradelake.sources.staging import written

FIELDS = ("lo", "hi", "base", "keep", "nbase", "nkeep")
_TABLE = "node bigint, " + ", ".join(f"{c} bigint" for c in FIELDS)
#: States lie between these.
LOWEST, HIGHEST = -(2**62), 2**62


def shortened(table: np.ndarray) -> np.ndarray:
    """The pieces, in order of lo, with neighbours of the same function as one."""
    table = table[table[:, 0] <= table[:, 1]]
    table = table[np.argsort(table[:, 0], kind="stable")]
    fresh = np.ones(len(table), bool)
    fresh[1:] = (table[1:, 2:] != table[:-1, 2:]).any(axis=1) | (table[1:, 0] != table[:-1, 1] + 1)
    starts = np.flatnonzero(fresh)
    out = table[starts].copy()
    out[:, 1] = table[np.append(starts[1:], len(table)) - 1, 1] if len(table) else out[:, 1]
    return out


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The table of doing ``first`` and ``then`` one after the other."""
    lo, hi, base, keep, nbase, nkeep = first.T
    image_lo, image_hi = base + keep * lo, base + keep * hi
    a = np.searchsorted(then[:, 0], image_lo, side="right") - 1
    b = np.searchsorted(then[:, 0], image_hi, side="right") - 1
    left = np.repeat(np.arange(len(first)), b - a + 1)
    right = np.arange(len(left)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + np.repeat(a, b - a + 1)
    f, t = first[left], then[right]
    moved = f[:, 3] == 1
    new_lo = np.where(moved, np.maximum(f[:, 0], t[:, 0] - f[:, 2]), f[:, 0])
    new_hi = np.where(moved, np.minimum(f[:, 1], t[:, 1] - f[:, 2]), f[:, 1])
    return shortened(np.stack([new_lo, new_hi, t[:, 2] + t[:, 3] * f[:, 2], t[:, 3] * f[:, 3], t[:, 4] + t[:, 5] * f[:, 4], t[:, 5] * f[:, 5]], axis=1))


def ends(jump: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(last place of the chain from each place, how many places it has), where jump[i] > i or is len(jump): by doubling of the pointers."""
    n = len(jump)
    last, to, count = np.arange(n), jump.copy(), np.ones(n, np.int64)
    while len(open_ := np.flatnonzero(to < n)):
        via = to[open_]
        count[open_] += count[via]
        last[open_], to[open_] = last[via], to[via]
    return last, count


def _by_part(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(one part's rows, in order, as a table) for each part, which gives tables."""

    def each(batches):
        held, part = [], None
        for batch in batches:
            at = batch.column("_part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)] if len(at) else []
            for a, b in zip(cuts, cuts[1:]):
                if part is not None and at[a] != part:
                    yield from work(pa.Table.from_batches(held)).to_batches()
                    held = []
                part = at[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("_part").sortWithinPartitions("_part", "_place").mapInArrow(each, schema)


def _segments(table: pa.Table) -> list[tuple[int, int]]:
    """The stretches of rows of one key."""
    at = table.column("_key").to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    return list(zip(cuts, cuts[1:]))


def _starts(rows: DataFrame, tables: DataFrame, initial: int) -> DataFrame:
    """(part, state, number) that each part begins with: composition up, states down."""
    levels = [tables]
    nodes = rows.agg(F.max("_part")).first()[0]  # parts are numbered from 0, and some may be missing

    def pair(_, part: pa.Table) -> pa.Table:
        node = part.column("node").to_numpy()
        both = np.stack([part.column(c).to_numpy() for c in FIELDS], axis=1)
        left, right = (shortened(both[node % 2 == k]) for k in (0, 1))
        out = composed(left, right) if len(left) and len(right) else left if len(left) else right
        return pa.table({"node": np.full(len(out), node[0] // 2), **{c: out[:, k] for k, c in enumerate(FIELDS)}})

    while nodes:
        up = levels[-1].withColumn("_up", F.shiftright("node", 1)).groupBy("_up").applyInArrow(lambda k, t: pair(k, t.drop_columns(["_up"])), _TABLE)
        levels.append(written(up, "composed"))
        nodes //= 2
    states = levels.pop().select("node").distinct().select("node", F.lit(initial).cast("bigint").alias("state"), F.lit(0).cast("bigint").alias("number"))
    while levels:
        here = levels.pop()
        above = states.select(F.col("node").alias("up"), "state", "number")
        there = here.select("node").distinct().withColumn("up", F.shiftright("node", 1)).join(above, "up").drop("up")
        # The right one begins where the left one, if there is one, ends.
        left = here.where("node % 2 = 0").join(above, F.shiftright("node", 1) == F.col("up")).where("state between lo and hi")
        after = left.select((F.col("node") + 1).alias("node"), (F.col("base") + F.col("keep") * F.col("state")).alias("s"), (F.col("nbase") + F.col("nkeep") * F.col("number")).alias("n"))
        states = written(there.join(after, "node", "left").select("node", F.coalesce("s", "state").alias("state"), F.coalesce("n", "number").alias("number")), "states")
    return states.select(F.col("node").cast("int").alias("_part"), "state", "number")


def folded(df: DataFrame, keys: list[str], order: list, columns: list[str], describe: Callable, replay: Callable, initial: int, out: dict[str, pa.DataType], kinds: str) -> DataFrame:
    """df with the columns ``out``, from a fold over each key's rows in order.

    describe(arrays) is the table of a stretch of one key's rows, given its ``columns`` as arrays; replay(arrays, state,
    number) gives (the new columns, state, number) of it. A key begins in the state ``initial`` with the number 0.
    """
    names = df.columns
    # A key's stretches are told apart by a number: equal neighbours of the order are one key.
    ranged = in_ranges(df, *keys, *order)
    w = Window.partitionBy("_part").orderBy("_place")
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(f"`{k}`").eqNullSafe(F.lag(f"`{k}`").over(w))
    ranged = written(ranged.withColumn("_key", F.sum(F.when(changed & (F.row_number().over(w) > 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))), "stretches")
    key = F.struct(*(F.col(f"`{k}`") for k in keys))
    rims = ranged.groupBy("_part").agg(F.min_by(key, "_place").alias("first"), F.max_by(key, "_place").alias("last"))
    # A row for each range.
    goes_on = F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(Window.orderBy("_part"))), F.lit(False)) & (F.row_number().over(Window.orderBy("_part")) > 1)
    rims = F.broadcast(written(rims.select("_part", goes_on.alias("_goes_on")), "rims"))

    def table_of(t: pa.Table) -> pa.Table:
        arrays = [t.column(c).to_numpy() for c in columns]
        parts = _segments(t)
        node = t.column("_part")[0].as_py()

        def fixed(table: np.ndarray) -> np.ndarray:
            """What a key that begins here ends with, whatever was before."""
            r = table[(table[:, 0] <= initial) & (initial <= table[:, 1])][0]
            return np.array([[LOWEST, HIGHEST, r[2] + r[3] * initial, 0, r[4], 0]], np.int64)

        a, b = parts[-1]
        found = describe(*(x[a:b] for x in arrays))
        if len(parts) > 1 or not t.column("_goes_on")[0].as_py():
            found = fixed(found)
        return pa.table({"node": np.full(len(found), node, np.int64), **{c: found[:, k] for k, c in enumerate(FIELDS)}})

    narrow = ranged.select("_part", "_place", "_key", *columns).join(rims, "_part")
    tables = written(_by_part(narrow, table_of, _TABLE), "tables")
    states = _starts(ranged, tables, initial)

    def replayed(t: pa.Table) -> pa.Table:
        arrays = [t.column(c).to_numpy() for c in columns]
        state, number = (t.column(c)[0].as_py() for c in ("state", "number"))
        if not t.column("_goes_on")[0].as_py():
            state, number = initial, 0
        made = []
        for a, b in _segments(t):
            made.append(replay(*(x[a:b] for x in arrays), state, number))
            state, number = initial, 0
        new = [pa.array(np.concatenate([m[k] for m in made]), kind) for k, kind in enumerate(out.values())]
        return pa.table([*(t.column(c) for c in names), *new], names=[*names, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return _by_part(ranged.join(rims, "_part").join(states, "_part"), replayed, f"{schema}, {kinds}")


# -- batches of bounded size ------------------------------------------------------------------------


def batch_pointers(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums before each item and of all, for each item the first of the next batch if one begins with it)."""
    sums = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
    return sums, np.searchsorted(sums[1:], sums[:-1] + limit, side="right")


def describe_batches(limit: int) -> Callable:
    """The state is what the open batch holds, -1 before the first item; the number is that of the open batch."""

    def describe(sizes: np.ndarray) -> np.ndarray:
        n = len(sizes)
        sums, jump = batch_pointers(sizes, limit)
        last, count = ends(jump)
        held = sums[-1] - sums[:-1][last]
        # The first batch that begins here begins with item j, the first that doesn't fit with what is held before.
        j = np.arange(n)
        lo, hi = np.maximum(limit - sums[1:] + 1, 0), limit - sums[:-1]
        one = np.ones(n, np.int64)
        table = np.stack([lo, hi, held[j], 0 * one, count[j], one], axis=1)
        none = [[0, limit - sums[-1], sums[-1], 1, 0, 1]]
        begin = [[-1, -1, held[0], 0, count[0] - 1, 0]]
        return shortened(np.concatenate([table[lo <= hi], none, begin]).astype(np.int64))

    return describe


def replay_batches(limit: int) -> Callable:
    def replay(sizes: np.ndarray, state: int, number: int) -> tuple[np.ndarray]:
        sums, jump = batch_pointers(sizes, limit)
        begins = np.zeros(len(sizes), np.int64)
        at = 0 if state < 0 else int(np.searchsorted(sums[1:], limit - state, side="right"))
        while at < len(sizes):
            begins[at] = 1
            at = int(jump[at])
        return (number + np.cumsum(begins) - (state < 0),)

    return replay


def bounded_batches(df: DataFrame, keys: list[str], order: list[str], size_col: str, limit: int) -> DataFrame:
    """Add ``batch`` from 0 per key: items in order, a new batch where the next would exceed the limit.

    Sizes are whole; a null counts as 0. One item over the limit, or below 0, is an error. The order should be
    unique within a key. A key may have any number of items: each range finds for every item where the next batch
    would begin, by sums and a search, and follows these pointers by doubling.
    """
    size = F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0))
    wrong = F.raise_error(F.format_string(f"an item of %d exceeds the batch limit of {limit}", size)).cast("bigint")
    rows = df.withColumn("_size", F.when((size > limit) | (size < 0), wrong).otherwise(size))
    return folded(rows, keys, order, ["_size"], describe_batches(limit), replay_batches(limit), -1, {"batch": pa.int64()}, "batch bigint").drop("_size")


# -- a circuit breaker ------------------------------------------------------------------------------

#: A closed circuit with a streak of s is the state CLOSED + s, one open since a time is that time in microseconds.
CLOSED = -(10**18)


def _openings(bad: np.ndarray, at: np.ndarray, threshold: int, wait: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bad calls in a row up to each, for a closed circuit without a streak before each call: which opens it, and the call after the wait)."""
    n = len(bad)
    i = np.arange(n)
    run = i - np.maximum.accumulate(np.where(bad, -1, i))
    full = np.flatnonzero(run >= threshold)
    k = np.searchsorted(full, i + threshold - 1)
    opens = np.append(full, n)[k]
    after = np.where(opens < n, np.searchsorted(at, at[np.minimum(opens, n - 1)] + wait, side="left"), n)
    return run, opens, after


def describe_circuit(threshold: int, wait: int) -> Callable:
    def describe(bad: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(bad)
        run, opens, after = _openings(bad, at, threshold, wait)
        last, _ = ends(np.maximum(after, np.arange(n) + 1))
        # From a closed circuit before call i on, the state at the end.
        fresh = np.where(opens[last] < n, at[np.minimum(opens[last], n - 1)], CLOSED + np.minimum(run[-1], n - last))
        rows = []
        lead = int(np.argmin(bad)) if not bad.all() else n
        for s in range(threshold):
            k = threshold - s - 1  # the call that opens it, if the first ones are all bad
            if k < lead:
                p = int(np.searchsorted(at, at[k] + wait, side="left"))
                end = fresh[p] if p < n else at[k]
            else:
                end = CLOSED + s + n if lead == n else fresh[0]
            rows.append([CLOSED + s, CLOSED + s, end, 0, 0, 1])
        # An open one lets the first call after the wait through.
        lo = np.concatenate([[CLOSED + threshold], at[:-1] - wait + 1])
        table = np.stack([lo, at - wait, fresh, np.zeros(n), np.zeros(n), np.ones(n)], axis=1).astype(np.int64)
        table[:, 2] = fresh  # exact, past what doubles hold
        table[:, 0], table[:, 1] = lo, at - wait
        rest = [[int(at[-1]) - wait + 1, HIGHEST, 0, 1, 0, 1]]
        return shortened(np.concatenate([np.array(rows, np.int64), table, np.array(rest, np.int64)]))

    return describe


def replay_circuit(threshold: int, wait: int) -> Callable:
    def replay(bad: np.ndarray, at: np.ndarray, state: int, number: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(bad)
        run, opens, after = _openings(bad, at, threshold, wait)
        i = np.arange(n)
        refused, streak = np.zeros(n, bool), np.zeros(n, np.int64)
        begin = 0
        if state >= CLOSED + threshold:  # open
            begin = int(np.searchsorted(at, state + wait, side="left"))
            refused[:begin], streak[:begin] = True, threshold
        elif state > CLOSED:
            s = state - CLOSED
            lead = int(np.argmin(bad)) if not bad.all() else n
            if threshold - s - 1 < lead:
                k = threshold - s - 1
                streak[: k + 1] = s + 1 + i[: k + 1]
                begin = int(np.searchsorted(at, at[k] + wait, side="left"))
                refused[k + 1 : begin], streak[k + 1 : begin] = True, threshold
            else:
                streak[:lead] = s + 1 + i[:lead]
                begin = lead
        while begin < n:
            end = min(int(opens[begin]) + 1, n)
            streak[begin:end] = np.minimum(run[begin:end], i[begin:end] - begin + 1)
            begin = int(after[begin]) if opens[begin] < n else n
            refused[end:begin], streak[end:begin] = True, threshold
        return refused, streak

    return replay


def circuit(df: DataFrame, keys: list[str], at: str, transient, other, threshold: int = 3, seconds: int = 30) -> DataFrame:
    """Add ``refused`` and ``streak`` to calls in the order of the timestamp ``at``: a circuit breaker for each key.

    After ``threshold`` transient failures in a row the circuit is open: calls are refused until ``seconds`` have
    passed since it opened, then counting starts anew. Success and ``other`` failures reset the count; a refused call
    changes nothing, whatever its own outcome is. Calls without a time have no place in the order: they change nothing,
    and both columns are null. Calls at one time have no order of their own. A key may have any number of calls.
    """
    bad = F.coalesce(transient & ~F.coalesce(other, F.lit(False)), F.lit(False))
    rows = df.withColumn("_bad", bad).withColumn("_us", F.unix_micros(F.col(f"`{at}`").cast("timestamp")))
    timed = rows.where("_us is not null")
    wait = seconds * 1_000_000
    out = folded(timed, keys, ["_us"], ["_bad", "_us"], describe_circuit(threshold, wait), replay_circuit(threshold, wait), CLOSED, {"refused": pa.bool_(), "streak": pa.int64()}, "refused boolean, streak bigint")
    untimed = rows.where("_us is null").withColumn("refused", F.lit(None).cast("boolean")).withColumn("streak", F.lit(None).cast("bigint"))
    return out.union(untimed).drop("_bad", "_us")
