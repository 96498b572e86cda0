"""Exact top-k and centroid clustering against brute force on vectors that are hard for their bounds."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelake.llm import centroids, topk
from gradelake.llm.centroids import clustered, nearest, orders
from gradelake.llm.topk import chosen_pivots, pivot_distances, search, top_k
from gradelake.llm.vectors import HELD

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id bigint, embedding array<float>, cluster string, e string, row string, score string, `a.b` string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], schema) if rows else spark.createDataFrame([], schema)


def scaled(x, scale):
    return [max(-HELD, min(HELD, math.floor(scale * float(np.float32(v))))) for v in x]


def fine(x):
    return x is not None and all(v is not None and math.isfinite(v) for v in x)


def plain_top(rows, every=50, k=5):
    kept = [(i, scaled(x, 256)) for i, x in rows if fine(x)]
    out = []
    for q, x in kept:
        if q is None or q % every:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(x, y)), i is None, i or 0) for i, y in kept if i != q))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clumps(n, dims, seed, spread=0.1):
    """Vectors about a few centres, a third of them the same, norms from small to large."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(7, dims)) * r.choice([0.01, 1, 5], size=(7, 1))
    x = centres[r.integers(0, 7, n)] + spread * r.normal(size=(n, dims))
    x[: n // 3] = centres[0]
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("dims", [2, 64])
def test_top_k_against_all_pairs(spark, dims):
    rows = clumps(1500, dims, dims)
    assert found(top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)) == plain_top(rows)


def test_top_k_in_many_groups_and_shares(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "PACK", 4)
    monkeypatch.setattr(topk, "SHARE", 2)
    rows = clumps(900, 8, 3)
    assert found(top_k(frame(spark, rows), F.col("vec_id") % 10 == 0)) == plain_top(rows, 10)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, []), (1, [1.0, NAN]), (2, None), (3, [None, 1.0]), (4, [INF, 0.0]), (None, [1.0, 2.0]), (None, [9.0, 0.0]), (5, [0.5]), (100, [3e38, -3e38]), (-50, [-1.0, -2.0, 4.0]), (6, [0.0, 0.0])]
    assert found(top_k(frame(spark, rows), F.col("vec_id") % 50 == 0)) == plain_top(rows)


def test_top_k_of_few_and_none(spark):
    assert found(top_k(frame(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0)) == []
    assert found(top_k(frame(spark, [(0, [1.0]), (7, [2.0])]), F.col("vec_id") % 50 == 0)) == [(0, 1, 7, 256 * 512)]
    assert top_k(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []


def test_search_stops_early_and_stays_exact():
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16)) * 300
    x = (centres[r.integers(0, 40, 4000)] + 5 * r.normal(size=(4000, 16))).astype(np.int64)
    pivots = chosen_pivots(x[:500].tolist())
    d, norms = pivot_distances(x, pivots), np.square(x.astype(float)).sum(axis=1)
    far = float(np.square(pivots).sum(axis=1).max())
    for i in range(0, 4000, 400):
        best, taken = search(x, norms, d, list(range(4000)), x[i], norms[i], d[i], i, far, 5, None)
        want = sorted(((-int(x[i] @ x[j]), j) for j in range(4000) if j != i))[:5]
        assert best == [(-s, j) for s, j in want] and taken < 2000


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, scaled(x, 64)) for i, x in rows if fine(x) and len(x) == 64]
    first = sorted(kept, key=lambda v: (hashlib.sha256(f"1:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1]))[:k]
    cs = [x for _, x in first]
    for r in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(cs)) for _, x in kept]
        if r < rounds:
            for n in range(len(cs)):
                mine = [x for (_, x), (_, m) in zip(kept, own) if m == n]
                cs[n] = [sum(v) // len(mine) for v in zip(*mine)] if mine else cs[n]
    per = collections.Counter()
    for d, n in own:
        per[n] += d
    most = 2**63 - 1
    return sorted(((i, n, d, min(per[n], most), min(sum(per.values()), most), hashlib.sha256(",".join(map(str, cs[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, own)), key=repr)


def test_clusters_against_all_distances(spark):
    for seed, spread in ((1, 0.3), (2, 0.0)):  # without spread, all vectors of a centre are equal, and centroids tie
        rows = clumps(400, 64, seed, spread)
        assert found(clustered(frame(spark, rows))) == plain_clusters(rows)


def test_clusters_of_odd_vectors(spark):
    random.seed(9)
    some = [(i % 9, [random.choice([-1.0, 0.0, 0.5]) for _ in range(64)]) for i in range(40)]
    odd = [(None, [0.25] * 64), (None, None), (3, [1.0] * 63), (4, [NAN] + [0.0] * 63), (5, [None] + [0.0] * 63), (6, [-INF] * 64), (7, [3e38] * 64), (8, [-3e38] * 64), (7, [3e38] * 64)]
    assert found(clustered(frame(spark, some + odd))) == plain_clusters(some + odd)
    assert found(clustered(frame(spark, some[:3]))) == plain_clusters(some[:3])
    assert clustered(frame(spark, odd[1:6])).collect() == [] and clustered(frame(spark, [])).collect() == []
    assert clustered(frame(spark, [])).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sort_means_leaves_out_what_cannot_be_nearer():
    r = np.random.default_rng(4)
    cs = (r.normal(size=(16, 64)) * 100).astype(np.int64)
    x = np.concatenate([c + r.integers(-9, 10, size=(50, 64)) for c in cs])
    before = np.repeat(np.arange(16), 50)
    best, least, taken = nearest(x, before, cs, *orders(cs))
    assert (best == before).all() and taken < 2 * len(x)
    wrong = np.zeros(len(x), np.int64)
    best, again, _ = nearest(x, wrong, cs, *orders(cs))
    assert (best == before).all() and (again == least).all()


def test_a_centroid_at_exactly_twice_the_distance_is_tried():
    cs = np.array([[4], [0]])
    best, least, _ = nearest(np.array([[2]]), np.array([1]), cs, *orders(cs))
    assert (best[0], least[0]) == (0, 4)  # a tie, which the smaller number takes


def test_constants_are_those_of_the_queries():
    assert (topk.SCALE, topk.TOP, centroids.SCALE, centroids.CLUSTERS, centroids.ROUNDS, centroids.SEED) == (256, 5, 64, 16, 3, 1)
