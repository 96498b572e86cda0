"""Centroid clustering by sort-means, in integers.

Each round the centroids, a bounded number, are sent to all tasks with their distances from each other. For each
centroid the others are ordered by distance from it. A vector starts at the centroid that it had before, at distance
d, and tries the others in that order until one is strictly farther than 2d from there: by the triangle
inequality neither it nor any after it can be as near as the first. Ties go to the smaller number, which is why a
centroid at exactly 2d is still tried. All distances are exact squares in longs.

Each round is one written table of (vec_id, e, cluster), which replaces the one before; new centroids are
floors of exact sums, which each task adds up before Spark adds those of the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.shared import dropped, staged
from gradelake.llm.vectors import matrix, scaled

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 64, 16, 3, 1
_LONGEST = 2**63 - 1


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of x from c."""
    apart = x - c
    return np.einsum("ij,ij->i", apart, apart)


def orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances between centroids, for each centroid the numbers of all by distance from it, then number)."""
    between = np.stack([squares(centroids, c) for c in centroids])
    return between, np.argsort(between, axis=1, kind="stable")


def nearest(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, between: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, number of distances taken) of each row of x, which had the centroid ``before``."""
    best, least, taken = before.copy(), np.zeros(len(x), np.int64), len(x)
    for a in range(len(centroids)):
        rows = np.flatnonzero(before == a)
        if not len(rows):
            continue
        mine = x[rows]
        first = squares(mine, centroids[a])
        at, dist = np.full(len(rows), a), first.copy()
        # Far ones last: those that stop at a centroid of the order have also stopped for all that follow.
        by_reach = np.argsort(-first, kind="stable")
        reach = -first[by_reach]
        for c in order[a]:
            if c == a:
                continue
            # Strictly beyond 2d: D > 2d, in squares D^2 > 4d^2, so (D^2 + 3) // 4 > d^2 without overflow.
            k = int(np.searchsorted(reach, -((int(between[a, c]) + 3) // 4), side="right"))
            if not k:
                break
            some = by_reach[:k]
            d = squares(mine[some], centroids[c])
            taken += k
            better = (d < dist[some]) | ((d == dist[some]) & (c < at[some]))
            at[some[better]], dist[some[better]] = c, d[better]
        best[rows], least[rows] = at, dist
    return best, least, taken


def _assigned(now: DataFrame, centroids: np.ndarray, name: str) -> DataFrame:
    """now (vec_id, e, cluster) with the cluster of the nearest centroid, and its squared distance."""
    kind = now.schema["vec_id"].dataType.simpleString()

    def each(batches):
        between, order = orders(centroids)
        for batch in batches:
            x = matrix(batch.column("e"), centroids.shape[1])
            best, least, _ = nearest(x, batch.column("cluster").to_numpy(), centroids, between, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("e"), pa.array(best, pa.int32()), pa.array(least, pa.int64())], names=["vec_id", "e", "cluster", "distance"])

    return staged(now.select("vec_id", "e", "cluster").mapInArrow(each, f"vec_id {kind}, e array<int>, cluster int, distance bigint"), name)


def _moved(now: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the clusters; a centroid of none stays."""
    k, dims = centroids.shape

    def each(batches):
        sums = np.zeros((k, dims + 1), np.int64)  # the last is the count
        for batch in batches:
            x, cluster = matrix(batch.column("e"), dims), batch.column("cluster").to_numpy()
            for c in np.unique(cluster):
                mine = x[cluster == c]
                sums[c, :dims] += mine.sum(axis=0)
                sums[c, dims] += len(mine)
        there = np.flatnonzero(sums[:, dims])
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(list(sums[there]), pa.list_(pa.int64()))], names=["cluster", "sums"])

    parts = now.select("cluster", "e").mapInArrow(each, "cluster int, sums array<bigint>")
    total = parts.select("cluster", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    found = {(r.cluster, r["at"]): int(r.x) for r in total.collect()}  # a number for each component of each centroid
    out = centroids.copy()
    for c in range(k):
        if n := found.get((c, dims)):
            out[c] = [found[c, j] // n for j in range(dims)]
    return out


def clustered(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector of ``dims`` finite components.

    Components become floor(scale * x), held to plus or minus 2**27 (which only sizes beyond 2 million reach). The
    first centroids are the k vectors whose ``seed:id`` has the smallest sha256; where ids repeat, also the smallest
    components. Null ids hash as an empty text. Fewer vectors than k give that many centroids; repeated rows are
    each assigned; a table without usable vectors gives no rows. Sums beyond a long are given as the longest one.
    Other columns aren't read, so their names don't matter.
    """
    spark = df.sparkSession
    before = now = staged(scaled(df, id_col, vec_col, scale).where(F.size("e") == dims), "vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = now.orderBy(mark, "e").limit(k).select("e").collect()
    centroids = np.array([r.e for r in seeds], np.int64).reshape(len(seeds), dims)
    now = now.withColumn("cluster", F.lit(0))
    for r in range(rounds + 1 if seeds else 0):
        now = _assigned(now, centroids, f"round{r}")
        dropped(before)
        before = now
        if r < rounds:
            centroids = _moved(now, centroids)
    if not seeds:
        return _described(spark, now.withColumn("distance", F.lit(0).cast("bigint")), [])
    held = {r.cluster: int(r.s) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    total = min(sum(held.values()), _LONGEST)
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return _described(spark, now, [(c, min(s, _LONGEST), total, marks[c]) for c, s in held.items()])


def _described(spark: SparkSession, now: DataFrame, per: list[tuple]) -> DataFrame:
    """now with the sums and marks of its clusters, a row for each."""
    clusters = spark.createDataFrame(per, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return now.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Rounds unrolled: (n, i, x) are the centroids' components, (vec_id, c, distance) the assignments."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
        p AS MATERIALIZED (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
        seeds AS (SELECT e, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS n FROM v QUALIFY n < {CLUSTERS}),
        c0 AS MATERIALIZED (SELECT n, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM seeds)"""
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (SELECT vec_id, n AS c, distance FROM (SELECT vec_id, n, CAST(sum((p.x - c{r}.x) * (p.x - c{r}.x)) AS BIGINT) AS distance FROM p JOIN c{r} USING (i) GROUP BY vec_id, n)
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, n) = 1)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""m{r} AS (SELECT c AS n, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM p JOIN a{r} USING (vec_id) GROUP BY 1, 2),
                c{r + 1} AS MATERIALIZED (SELECT n, i, CASE WHEN k IS NULL THEN x ELSE (s - ((s % k) + k) % k) // k END AS x FROM c{r} LEFT JOIN m{r} USING (n, i))"""
            )
    return f"""WITH {", ".join(parts)},
        marks AS (SELECT n AS c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY n)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{ROUNDS} JOIN marks USING (c)"""


OP12_SQL = _sql()
