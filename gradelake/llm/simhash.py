"""SimHash near-duplicates: a Gray-order hierarchical index over 64-bit fingerprints.

Fingerprints within ``distance`` = 3 differing bits link, and documents in one connected component of links
are one group. The index has two kinds of level.

* Upper nodes are dealt over the cluster. Four blocks of w bits are laid out over the 64; two fingerprints that
  differ in at most three bits agree on a whole block, so the nodes (block, pattern on it) meet every link. w
  follows from the count of fingerprints, so that a node holds about ``NODE_ROWS`` of them at any size. A node
  with more than ``LARGE`` is factored again on its remaining bits, by the 20 choices of three of six blocks,
  and what is still too large once more; after that 15 bits at most are left, so no node can hold more than
  2^15 different fingerprints, however large a group of near copies is. Nothing is capped.
* Inside a node, fingerprints are sorted by Gray rank. Each group of eight consecutive codes becomes a tree
  node holding the bits that all share, groups of groups likewise. A search adds up differences on newly
  fixed bits from the root down and drops a whole group once they exceed three, and also where all of the
  group is already known to be connected with the query. Every link is found by such a search.

Each node returns only a spanning forest of its links. Components are then found by rounds of large-star and
small-star steps on aggregates, whose tables are written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import dropped, staged

BITS, DISTANCE = 64, 3
#: Fingerprints in an upper node, about, and those beyond which it is factored again.
NODE_ROWS, LARGE = 2_000, 30_000
FANOUT = 8
#: Rows of nodes for a task, about.
TASK_ROWS = 50_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of a text: words split at ASCII white space, A-Z in lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype=">u8", count=n)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 15):  # a very long text is counted in parts
        ones += np.unpackbits(h[a : a + (1 << 15)].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row: fp is the fingerprint as a signed long.

    Null, empty and wordless texts have the fingerprint 0. Null and repeated ids are kept, rows of equal texts have equal
    fingerprints, other columns are ignored, and an empty table gives no rows. A text may be of any length.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column("text")), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in reflected Gray order: the running XOR of its bits from the top."""
    out = codes.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


class GrayIndex:
    """A static tree over codes (uint64): levels of (pattern, own bits, number of children), leaves first."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        pattern, shared = self.codes, np.full(len(codes), full)
        levels = []
        while True:
            if len(pattern) <= FANOUT:
                levels.append((pattern, shared))
                break
            at = np.arange(0, len(pattern), FANOUT)
            first = np.repeat(pattern[at], np.diff(np.append(at, len(pattern))))
            up = np.bitwise_and.reduceat(shared, at) & ~np.bitwise_or.reduceat(pattern ^ first, at)
            own = shared & ~np.repeat(up, np.diff(np.append(at, len(pattern))))
            levels.append((pattern, own))
            pattern, shared = pattern[at], up
        self.levels = levels[::-1]

    def ranges(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and greatest label below each node, by level from the root."""
        low, high = label, label
        out = [(low, high)]
        for pattern, _ in self.levels[-2::-1]:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append((low, high))
        return out[::-1]

    def search(self, queries: np.ndarray, distance: int = DISTANCE, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query number, place in codes) within the distance, for a few queries at a time.

        known: (labels of the queries, ranges of the codes' labels); what has the label of the query is left out.
        """
        pattern, own = self.levels[0]
        q, node = np.divmod(np.arange(len(queries) * len(pattern)), len(pattern))
        acc = np.zeros(len(q), np.uint8)
        for depth, (pattern, own) in enumerate(self.levels):
            if depth:
                n = len(q)
                q, acc = np.repeat(q, FANOUT), np.repeat(acc, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).reshape(-1) if n else node
                inside = node < len(pattern)
                q, acc, node = q[inside], acc[inside], node[inside]
            acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            near = acc <= distance
            if known is not None:
                mine, (low, high) = known[0][q], known[1][depth]
                near &= (low[node] != mine) | (high[node] != mine)
            q, node, acc = q[near], node[near], acc[near]
        return q, node


def forest(codes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for every code that links, directly or through others here, to a smaller root."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for at in range(0, len(codes), STEP):
        q, found = index.search(index.codes[at : at + STEP], distance, (label[at : at + STEP], index.ranges(label)))
        label = _merged(label, q + at, found)
    smallest = np.full(len(label), np.iinfo(np.int64).max)
    signed = index.codes.view(np.int64)
    np.minimum.at(smallest, label, signed)
    root = smallest[label]
    own = root != signed
    return signed[own], root[own]


#: Queries that go down the tree together.
STEP = 64


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), low)
        while (label[label] != label).any():
            label = label[label]


def _masks(bits: list[int], blocks: int = 6, erased: int = DISTANCE) -> list[int]:
    """Masks that keep all blocks of the given bits but ``erased`` of them, for each such choice."""
    parts = [[int(b) for b in x] for x in np.array_split(np.array(bits), blocks)]
    return [sum(1 << b for part in keep for b in part) for keep in combinations(parts, blocks - erased)]


def _top_masks(n: int) -> list[int]:
    """One mask for each of four blocks of so many bits that n codes make nodes of about NODE_ROWS; one empty mask for few codes."""
    w = min(BITS // 4, max(0, (max(1, n // NODE_ROWS) - 1).bit_length()))
    return [((1 << w) - 1) << (BITS // 4 * k) for k in range(DISTANCE + 1)] if w else [0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _nodes(df: DataFrame, choices: list[tuple[int, int]]) -> DataFrame:
    """(node, fp) of each fingerprint for each (number, mask); node hashes number and pattern, and a chance meeting of two nodes costs only time."""
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in choices))
    return df.select(F.explode(keys).alias("node"), "fp")


def _searched(nodes: DataFrame, parts: int) -> DataFrame:
    """Spanning forests (a, b) of all nodes, dealt to so many tasks, each node inside one; the rows of a node stream in sorted order."""

    def each(batches):
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = iter(batches)
        while True:
            batch = next(ends, None)
            if batch is not None:
                keys, fps = np.append(keys, batch.column("node").to_numpy()), np.append(fps, batch.column("fp").to_numpy())
            if not len(keys):
                if batch is None:
                    return
                continue
            cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1], side="left"))
            at = np.flatnonzero(np.append(True, keys[1:cut] != keys[: cut - 1])) if cut else np.empty(0, int)
            ends_at = np.append(at[1:], cut)
            a, b = [], []
            for s, e in zip(at[ends_at - at > 1], ends_at[ends_at - at > 1]):
                x, y = forest(fps[s:e].view(np.uint64))
                if len(x):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            keys, fps = keys[cut:], fps[cut:]
            if batch is None:
                return

    # A stated number of partitions: the rows are few bytes but much work, so they must not be put together by size.
    return nodes.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(each, "a bigint, b bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) pairs of fingerprints whose components are those of all links among the distinct fingerprints fp, read more than once."""
    n = distinct.count()
    choices = list(enumerate(_top_masks(n)))
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // TASK_ROWS)
    out, rows = None, distinct
    while True:
        nodes = _nodes(rows, choices)
        last = choices[0][1].bit_count() >= BITS - 15
        large = None if last else staged(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("node"), "large")
        if last or large.isEmpty():
            found = _searched(nodes, parts)
            return found if out is None else out.union(found)
        found = _searched(nodes.join(F.broadcast(large) if large.count() <= MOST_SENT else large, "node", "left_anti"), parts)
        out = found if out is None else out.union(found)
        # The rows of a large node, and the mask that made it, give its smaller nodes. A mask can come up twice by two ways; that costs time only.
        sides = [rows.select(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("node"), "fp") for k, m in choices]
        mine = sides[0]
        for x in sides[1:]:
            mine = mine.union(x)
        mine = mine.join(F.broadcast(large) if large.count() <= MOST_SENT else large, "node", "left_semi")
        used = [r.k for r in mine.select("k").distinct().collect()]  # as many as masks at most
        finer = [(k, mask | m) for k, mask in choices if k in used for m in _masks([b for b in range(BITS) if not mask >> b & 1])]
        choices = [(1000 + i, m) for i, m in enumerate(dict.fromkeys(m for _, m in finer))]
        rows = staged(mine.select("fp").distinct(), "codes")


#: Large nodes that are sent to all executors at most; beyond, nodes are shuffled to them.
MOST_SENT = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the smallest of its component. Rounds end when nothing changes."""
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        sides = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are written before they are joined, so that both sides are plain exchanges and a hot root can be split.
        low = staged(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        # Large star: larger neighbours go to the smallest one.
        large = staged(sides.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: a node's smaller neighbours and itself go to the smallest one.
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        new = staged(small, "edges")
        mark = tuple(new.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(b as decimal(38,0)))")).first())
        for x in (now, low, large, least):
            dropped(x)
        now = new
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of df.

    component_id is the smallest doc_id in the connected component of links. Null, empty and wordless texts
    have fingerprint zero and link like any other. Null ids never become a component_id unless a component
    has no other; repeated rows are returned as often as they stand. Other columns are ignored; an empty
    table gives no rows. A text may be of any length.
    """
    rows = staged(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    linked = components(links(staged(rows.select("fp").distinct(), "codes")))
    return grouped(rows, linked).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def grouped(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, doc_id, component_id) for each row (doc_id, fp), given the components (node, root) of the different fp."""
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    members = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
    firsts = members.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first").alias("component_id"))
    # Written first, so that both sides of the join are plain exchanges and a hot component can be split.
    named = members.join(staged(firsts, "roots"), "root").select("node", "component_id")
    named = distinct.join(named, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # A fingerprint that many documents share is hot here: again a join of two plain exchanges.
    return rows.join(staged(named, "named"), "fp")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
