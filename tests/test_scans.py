"""Sequential folds done in ranges equal the fold done row by row, on hot keys over many ranges."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradelake.operators import ops, scans
from gradelake.operators.scans import CLOSED, composed, describe_batches, describe_circuit, replay_batches, replay_circuit


def plain_batches(sizes, limit):
    out, used, number = [], 0, 0
    for k, s in enumerate(sizes):
        if k and used + s > limit:
            used, number = 0, number + 1
        used += s
        out.append(number)
    return out


def plain_circuit(calls, threshold, wait):
    out, streak, opened = [], 0, None
    for bad, at in calls:
        if opened is not None and at - opened >= wait:
            streak, opened = 0, None
        refused = opened is not None
        if not refused:
            streak = streak + 1 if bad else 0
            opened = at if streak >= threshold else None
        out.append((refused, streak))
    return out


def applied(table, state, number):
    lo, hi, base, keep, nbase, nkeep = next(r for r in table.tolist() if r[0] <= state <= r[1])
    return base + keep * state, nbase + nkeep * number


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10), min_size=1, max_size=60), st.integers(1, 59), st.integers(10, 25))
def test_batches_of_two_parts(sizes, cut, limit):
    x = np.array(sizes)
    whole = plain_batches(sizes, limit)
    describe, replay = describe_batches(limit), replay_batches(limit)
    assert replay(x, -1, 0)[0].tolist() == whole
    if cut < len(x):
        state, number = applied(describe(x[:cut]), -1, 0)
        assert replay(x[:cut], -1, 0)[0].tolist() + replay(x[cut:], state, number)[0].tolist() == whole
        assert applied(composed(describe(x[:cut]), describe(x[cut:])), -1, 0) == applied(describe(x[cut:]), state, number) == applied(describe(x), -1, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 6)), min_size=1, max_size=60), st.integers(1, 59), st.integers(1, 4), st.integers(1, 20), st.integers(-50, 50))
def test_circuit_of_two_parts(calls, cut, threshold, wait, start):
    at = start + np.cumsum([gap for _, gap in calls])
    bad = np.array([b for b, _ in calls])
    whole = plain_circuit(list(zip(bad.tolist(), at.tolist())), threshold, wait)
    describe, replay = describe_circuit(threshold, wait), replay_circuit(threshold, wait)
    pairs = lambda r: list(zip(r[0].tolist(), r[1].tolist()))
    assert pairs(replay(bad, at, CLOSED, 0)) == whole
    if cut < len(bad):
        state, _ = applied(describe(bad[:cut], at[:cut]), CLOSED, 0)
        assert pairs(replay(bad[:cut], at[:cut], CLOSED, 0)) + pairs(replay(bad[cut:], at[cut:], state, 0)) == whole
        assert applied(composed(describe(bad[:cut], at[:cut]), describe(bad[cut:], at[cut:])), CLOSED, 0)[0] == applied(describe(bad, at), CLOSED, 0)[0]


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ops, "RANGE", 150)


def test_batches_of_a_hot_key(spark, many_ranges):
    rng = random.Random(3)
    rows = [(None if k < 900 else k % 7, k, 7 if k < 400 else rng.choice([None, 0, 1, 5, 20])) for k in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key int, n int, size int").withColumn("batch_note", F.lit("x"))
    got = {(r.key, r.n): r.batch for r in scans.bounded_batches(df, ["key"], ["n"], "size", 20).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        mine = sorted((n, s or 0) for k, n, s in rows if k == key)
        want |= {(key, n): b for (n, _), b in zip(mine, plain_batches([s for _, s in mine], 20))}
    assert got == want


def test_circuit_of_a_hot_key(spark, many_ranges):
    rng = random.Random(4)
    at, rows = 0, []
    for k in range(1200):
        at += rng.choice([0, 1, 1, 5, 40]) if k % 200 < 150 else 1
        rows.append(("hot" if k % 10 else "cold", at * 10 + k % 10 if k % 97 else None, rng.random() < (0.9 if k % 200 < 100 else 0.4), k))
    df = spark.createDataFrame(rows, "key string, ms bigint, bad boolean, k int").withColumn("at", F.timestamp_millis("ms"))
    out = scans.circuit(df, ["key"], "at", F.col("bad"), F.lit(None).cast("boolean"), seconds=1).collect()
    assert all(r.refused is None and r.streak is None for r in out if r.ms is None) and len(out) == len(rows)
    for key in ("hot", "cold"):
        mine = sorted((r.ms, r.k) for r in out if r.key == key and r.ms is not None)
        assert len({m for m, _ in mine}) == len(mine)
        flag = {r[3]: r[2] for r in rows}
        want = plain_circuit([(flag[k], m * 1000) for m, k in mine], 3, 1_000_000)
        got = {r.k: (r.refused, r.streak) for r in out}
        assert [got[k] for _, k in mine] == want and any(w[0] for w in want)


def test_empty_and_too_large(spark):
    df = spark.createDataFrame([], "key int, n int, size int")
    assert scans.bounded_batches(df, ["key"], ["n"], "size", 20).collect() == []
    assert scans.circuit(df.withColumn("at", F.current_timestamp()), ["key"], "at", F.lit(True), F.lit(False)).collect() == []
    with pytest.raises(Exception, match="an item of 21 exceeds the batch limit of 20"):
        scans.bounded_batches(spark.createDataFrame([(1, 1, 21)], "key int, n int, size int"), ["key"], ["n"], "size", 20).collect()
