"""Exact top-k by inner product, with a table of distances to pivots.

For integer vectors the inner product of q and x is (|q|^2 + |x|^2 - d(q,x)^2) / 2. The table holds each row's
distances to ``PIVOTS`` pivots; the largest |d(q,p) - d(x,p)| over the pivots p is a lower bound of d(q,x), so it gives
an upper bound of the product. A query takes candidates in the order of their bounds and stops at the first
bound below its k-th best product, so the result is exact; bounds carry an allowance for rounded distances.

Rows are dealt into groups by their nearest pivot and the distance from it, and stored in blocks. A group has a
summary, the range of its distances to each pivot, which bounds the products of all its rows; summaries are at
most ``GROUPS`` short rows and are sent to all tasks. Every query first searches the groups with the highest bounds
that hold enough rows, which gives it a k-th best product, then all others whose bound reaches that.
Queries travel in packs to the groups that they want, and packs meet blocks in a join on the group, so
neither all rows nor all queries are ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.llm.shared import dropped, staged
from gradelake.llm.vectors import matrix, scaled

SCALE, TOP = 256, 5
PIVOTS, SAMPLE = 32, 1024
#: Rows of a block, queries of a pack, and the most groups, whose summaries are 4 MB.
BLOCK, PACK, GROUPS = 1024, 64, 16_384
#: Packs of one group that meet a block in one place; beyond, blocks are copied for each such share.
SHARE = 1000
#: Allowance of a bound, in parts of the squared norms: distances are single floats, of 24 bits.
SLACK = 2.0**-18
_LONGEST = 2**63 - 1


def chosen_pivots(sample: list[list[int]], n: int = PIVOTS) -> np.ndarray:
    """Up to n of the sample's different vectors, each as far as can be from those before it."""
    width = max(map(len, sample), default=0)
    x = np.zeros((len(sample), width))
    for i, e in enumerate(sample):
        x[i, : len(e)] = e
    left = np.full(len(x), np.inf)
    out: list[int] = []
    while len(out) < min(n, len(x)):
        k = int(np.argmax(left))
        if out and left[k] <= 0:
            break
        out.append(k)
        left = np.minimum(left, np.linalg.norm(x - x[k], axis=1))
    return x[out]


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows from pivots; the narrower of the two counts as filled with zeros."""
    width = max(x.shape[1], pivots.shape[1])
    x, p = (np.pad(m.astype(np.float64), ((0, 0), (0, width - m.shape[1]))) for m in (x, pivots))
    out = np.empty((len(x), len(p)), np.float32)
    for j in range(len(p)):
        out[:, j] = np.sqrt(np.square(x - p[j]).sum(axis=1))
    return out


def _table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (vec_id, e) with row, a number of its own, norm (squared), near, the pivot next to it, and d, the distances."""
    kind = rows.schema["vec_id"].dataType.simpleString()

    def each(batches):
        for batch in batches:
            x = matrix(batch.column("e"))
            d = pivot_distances(x, pivots)
            near = d.argmin(axis=1)
            out = [batch.column(c) for c in ("row", "vec_id", "e")] + [pa.array(np.square(x.astype(np.float64)).sum(axis=1)), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near]), pa.array(list(d), pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(out, names=["row", "vec_id", "e", "norm", "near", "apart", "d"])

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "e")
    return staged(numbered.mapInArrow(each, f"row bigint, vec_id {kind}, e array<int>, norm double, near int, apart float, d array<float>"), "pivot-table")


_BLOCK = "group int, ids array<bigint>, width int, x binary, norm array<double>, d binary, lo array<float>, hi array<float>, top double"


def _blocks(table: DataFrame, groups: int) -> DataFrame:
    """Blocks of rows that are alike: group, ids, x (longs), norm, d, the range of each pivot's distances, the largest norm."""

    def packed(rows: pa.Table, group: int) -> pa.RecordBatch:
        x = matrix(rows.column("e"))
        d = np.stack(rows.column("d").to_numpy())
        norm = rows.column("norm").to_numpy()
        one = [[group], [rows.column("vec_id").to_pylist()], [x.shape[1]], [x.tobytes()], [norm], [d.tobytes()], [d.min(axis=0)], [d.max(axis=0)], [norm.max()]]
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(one, kinds)], names=["group", "ids", "width", "x", "norm", "d", "lo", "hi", "top"])

    def each(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= BLOCK:
                rows = pa.Table.from_batches(held)
                yield packed(rows.slice(0, BLOCK), rows.column("group")[0].as_py())
                held, count = rows.slice(BLOCK).to_batches(), count - BLOCK
        if count:
            rows = pa.Table.from_batches(held)
            yield packed(rows, rows.column("group")[0].as_py())

    # The row number is part of the order, so equal vectors, however many, are cut too.
    dealt = table.select("vec_id", "e", "norm", "d", "near", "apart", "row").repartitionByRange(groups, "near", "apart", "row").sortWithinPartitions("near", "apart", "row")
    alike = dealt.select(F.col("vec_id").cast("bigint"), "e", "norm", "d", F.spark_partition_id().alias("group"))
    return staged(alike.mapInArrow(each, _BLOCK), "blocks")


class Summaries:
    """Ranges of the distances of each group, as arrays: at most GROUPS rows."""

    def __init__(self, blocks: DataFrame):
        pivots = len((blocks.select("lo").first() or [[]])[0])
        ends = [f(F.col(c)[j]).alias(f"{c}{j}") for c, f in (("lo", F.min), ("hi", F.max)) for j in range(pivots)]
        rows = blocks.groupBy("group").agg(F.max("top").alias("top"), F.sum(F.size("ids")).alias("n"), *ends).collect()
        self.group = np.array([r.group for r in rows], np.int64)
        self.top = np.array([r.top for r in rows], np.float64)
        self.n = np.array([r.n for r in rows], np.int64)
        self.lo, self.hi = (np.array([[r[f"{c}{j}"] for j in range(pivots)] for r in rows], np.float32).reshape(len(rows), pivots) for c in ("lo", "hi"))

    def bounds(self, d: np.ndarray, norm: float, far: float) -> np.ndarray:
        """Upper bounds of the products of a query with each group."""
        return bound(np.maximum(self.lo - d, d - self.hi).max(axis=1, initial=0), norm, self.top, far)


def bound(least: np.ndarray, norm: float, norms: np.ndarray, far: float) -> np.ndarray:
    """Upper bounds of products, where distances are ``least`` at least; far is the largest squared norm of a pivot."""
    gap = least.astype(np.float64)
    return (norm + norms - gap * gap) / 2 + SLACK * (norm + norms + far)


_PACK = "group int, qrow array<bigint>, qid array<bigint>, width int, qx binary, qnorm array<double>, qd binary, floor array<bigint>"


def _packs(queries: DataFrame, summaries: Summaries, far: float, k: int, first: bool) -> DataFrame:
    """Queries in packs for each group that they want.

    First, the groups with the highest bounds that hold k rows beside the query's own; then, for queries with a
    ``floor``, all others whose bounds reach it (all others if it is null).
    """

    def homes(ub: np.ndarray) -> np.ndarray:
        order = np.argsort(-ub, kind="stable")
        enough = int(np.searchsorted(np.cumsum(summaries.n[order]), k + 1)) + 1
        return order[:enough]

    def each(batches) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, d = matrix(batch.column("e")), np.stack(batch.column("d").to_numpy(zero_copy_only=False))
                norm, row, qid = batch.column("norm").to_numpy(), batch.column("row").to_numpy(), batch.column("vec_id").to_pylist()
                floor = batch.column("floor").to_pylist()
                wanted = np.zeros((len(row), len(summaries.group)), bool)
                for i in range(len(row)):
                    ub = summaries.bounds(d[i], norm[i], far)
                    home = homes(ub)
                    if first:
                        wanted[i, home] = True
                    else:
                        wanted[i] = True if floor[i] is None else ub >= floor[i]
                        wanted[i, home] = False
                for g in np.flatnonzero(wanted.any(axis=0)):
                    mine = np.flatnonzero(wanted[:, g])
                    for p in range(0, len(mine), PACK):
                        some = mine[p : p + PACK]
                        one = [[summaries.group[g]], [row[some]], [[qid[i] for i in some]], [x.shape[1]], [x[some].tobytes()], [norm[some]], [d[some].tobytes()], [[floor[i] for i in some]]]
                        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(one, kinds)], names=["group", "qrow", "qid", "width", "qx", "qnorm", "qd", "floor"])

    return staged(queries.select("row", "vec_id", "e", "norm", "d", "floor").mapInArrow(each, _PACK), "packs")


def products(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Exact products of rows with q; those beyond a long are given as the nearest one."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64).tolist()
    return [max(-_LONGEST - 1, min(_LONGEST, int(v))) for v in x.astype(object) @ q.astype(object)]


def _id_key(i: int | None) -> tuple:
    return (i is None, i or 0)


def search(x: np.ndarray, norms: np.ndarray, d: np.ndarray, ids: list, q: np.ndarray, norm: float, dq: np.ndarray, own: int | None, far: float, k: int, floor: int | None) -> tuple[list[tuple[int, int]], int]:
    """([(product, id)] of the k best rows that reach the floor, number of products taken). Rows with the query's id are its own."""
    ub = bound(np.abs(d - dq).max(axis=1, initial=0), norm, norms, far)
    some = np.arange(len(ub)) if floor is None else np.flatnonzero(ub >= floor)
    some = some[np.argsort(-ub[some], kind="stable")]
    best: list[tuple[int, int]] = []
    at, step, taken = 0, 4 * k, 0
    while at < len(some) and (floor is None or ub[some[at]] >= floor):
        now = some[at : at + step]
        at, step, taken = at + step, 4 * step, taken + len(now)
        best += [(s, ids[i]) for s, i in zip(products(x[now], q), now) if (own is None or ids[i] != own) and (floor is None or s >= floor)]
        best = sorted(best, key=lambda b: (-b[0], *_id_key(b[1])))[:k]
        if len(best) == k:
            floor = best[-1][0]
    return best, taken


def _found(packs: DataFrame, blocks: DataFrame, far: float, k: int) -> DataFrame:
    """(row, query_id, vec_id, score): the best rows of each block for each query of the packs of its group."""
    most = packs.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    shares = max(1, -(-most // SHARE))
    left = blocks.drop("lo", "hi", "top").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    right = packs.withColumnRenamed("width", "qwidth").withColumn("share", F.pmod(F.xxhash64("qrow"), F.lit(shares)).cast("int"))
    both = left.join(right, ["group", "share"])

    def each(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for r in batch.to_pylist():
                n, m, width = len(r["ids"]), len(r["qrow"]), max(r["width"], r["qwidth"])
                x = np.pad(np.frombuffer(r["x"], np.int64).reshape(n, r["width"]), ((0, 0), (0, width - r["width"])))
                qx = np.pad(np.frombuffer(r["qx"], np.int64).reshape(m, r["qwidth"]), ((0, 0), (0, width - r["qwidth"])))
                d, qd = np.frombuffer(r["d"], np.float32).reshape(n, -1), np.frombuffer(r["qd"], np.float32).reshape(m, -1)
                norms = np.array(r["norm"])
                for i in range(m):
                    best, _ = search(x, norms, d, r["ids"], qx[i], r["qnorm"][i], qd[i], r["qid"][i], far, k, r["floor"][i])
                    out[0] += [r["qrow"][i]] * len(best)
                    out[1] += [r["qid"][i]] * len(best)
                    out[2] += [b[1] for b in best]
                    out[3] += [b[0] for b in best]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["row", "query_id", "vec_id", "score"])

    return staged(both.select("ids", "width", "x", "norm", "d", "qrow", "qid", "qwidth", "qx", "qnorm", "qd", "floor").mapInArrow(each, "row bigint, query_id bigint, vec_id bigint, score bigint"), "found")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k other rows with the largest products, ties to smaller ids.

    queries is a test on ``vec_id``. Components become floor(scale * x), held to plus or minus 2**27. Rows whose
    vector is null or holds a null or non-finite component take no part; vectors of different lengths meet as if the
    shorter ended in zeros, so an empty one scores 0. Rows with the query's id count as its own; a null id is no
    query and comes last in ties. Repeated rows are candidates each, and queries each. Fewer candidates than k give
    fewer rows, an empty table none. Other columns aren't read.
    """
    rows = staged(scaled(df, id_col, vec_col, scale), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id", "e")).limit(SAMPLE).select("e").collect()
    pivots = chosen_pivots([list(r.e) for r in sample])
    far = float(np.square(pivots).sum(axis=1).max(initial=0))
    table = _table(rows, pivots)
    blocks = _blocks(table, max(1, min(GROUPS, table.count() // BLOCK)))
    summaries = Summaries(blocks)
    asked = table.where(queries)
    packs = _packs(asked.withColumn("floor", F.lit(None).cast("bigint")), summaries, far, k, True)
    home = _found(packs, blocks, far, k)
    floors = _ranked(home, k).where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
    dropped(packs)
    rest = _packs(asked.join(floors, "row", "left"), summaries, far, k, False)
    found = _found(rest, blocks, far, k)
    for x in (rows, table, blocks, rest):
        dropped(x)
    kind = df.schema[id_col].dataType
    return _ranked(home.union(found), k).select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP11_SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= {TOP}"""
