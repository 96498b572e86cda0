"""Groups of texts whose five-word shingles have a Jaccard similarity of at least 0.8.

A text's set of shingle hashes gives ``BANDS`` keys of ``ROWS`` minima each (min-wise hashing); two texts at
similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.997 at 0.8, 0.12 at 0.5, 0.002 at 0.3. Texts
that share a key, or a group that the caller proposes, are compared, first by small bitmaps of the parity of shingles per bit, which differ in no more
bits than the sets do in shingles, then by their whole sets, so no link is below the similarity. Texts with equal
sets are one entry. Shingles and sets are told apart by 64-bit hashes.

The texts of a key are not compared all with all at first. Each is compared with one hub, the text whose keys
are the most frequent, which in a group of near copies is close to the text that they were made from; so a group is
joined by a comparison each. A hub that has met all others leaves. Where texts of a key are still in different
components, all of a key of at most ``MOST_EACH`` texts are compared by bitmaps of 512 bits inside the join; a larger key
takes more hubs, sixteen times as many each time, until it is small enough or joined. No candidate is left out.
The sets of a comparison aren't copied for it: each candidate's set travels once to its hub's, which is there once a
task, and a hub with many candidates has several tasks.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import dropped, staged
from gradelake.llm.simhash import _LOWER, components, grouped

SHINGLE = 5
#: The least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 32, 8
#: Texts of a key up to which all its pairs are tested on their short bitmaps.
MOST_EACH = 2_000
#: Candidates of one hub that are verified in one place, about; each such place has a copy of its set.
SHARE = 250
#: Bits of the short bitmaps.
SHORT = 512
#: Texts whose sets are wanted that are sent to all executors at most; beyond, texts are shuffled to them.
MOST_SENT = 200_000


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of a text's shingles, words as in ``simhash.fingerprint``; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(5)), dtype=np.uint64, count=max(1, len(words) - shingle + 1)))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of the min-wise hashes, from a fixed rule."""
    n = BANDS * ROWS
    drawn = np.array([xxhash.xxh64_intdigest(f"minimum {k}") for k in range(2 * n)], dtype=np.uint64)
    return drawn[:n] | np.uint64(1), drawn[n:]


def band_keys(h: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One key for each band: a hash of its number and its minima."""
    a, b = factors
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    # In parts that stay in a core's cache, which a very long text or all factors at once would not.
    for at in range(0, len(h), 1024):
        for k in range(0, len(a), 64):
            hashed = h[None, at : at + 1024] * a[k : k + 64, None] + b[k : k + 64, None]
            least[k : k + 64] = np.minimum(least[k : k + 64], hashed.min(axis=1))
    return np.fromiter((xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, len(a), ROWS)), dtype=np.uint64, count=BANDS)


def parity(h: np.ndarray) -> bytes:
    """For each low part of a hash, whether an odd number of hashes has it; at least two bits a hash, a power of two."""
    m = max(64, 1 << (2 * len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1).tobytes()


def short_parity(h: np.ndarray) -> np.ndarray:
    """The same for a fixed number of bits, as longs."""
    odd = np.bincount((h & np.uint64(SHORT - 1)).astype(np.int64), minlength=SHORT).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two such bitmaps differ, the longer one folded to the length of the other."""
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(v, np.uint8).reshape(-1, n), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _keyed(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, t, sid, n, bits, short, keys): sid hashes the set of n shingles, bits and short are its parity bitmaps, t the text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def each(batches):
        factors = _factors()
        for batch in batches:
            sid, size, bits, short, keys = [], [], [], [], []
            for x in batch.column("text"):
                h = shingles(x.as_py(), shingle)
                sid.append(xxhash.xxh64_intdigest(h.tobytes()))
                size.append(len(h))
                bits.append(parity(h))
                short.append(short_parity(h))
                keys.append(band_keys(h, factors).view(np.int64))
            ids = pa.array(np.array(sid, np.uint64).view(np.int64))
            out = [batch.column("doc_id"), batch.column("t"), ids, pa.array(size, pa.int64()), pa.array(bits, pa.binary()), pa.array(short, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "t", "sid", "n", "bits", "short", "keys"])

    return rows.mapInArrow(each, f"doc_id {kind}, t bigint, sid bigint, n bigint, bits binary, short array<bigint>, keys array<bigint>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(sid, hs) for each row of (sid, text)."""

    def each(batches):
        for batch in batches:
            hs = [shingles(x.as_py(), shingle).view(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(hs, pa.list_(pa.int64()))], names=["sid", "hs"])

    return texts.mapInArrow(each, "sid bigint, hs array<bigint>")


def _possible(pairs: DataFrame, entries: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The (a, b) of pairs whose bitmaps allow the similarity."""
    p, q = least
    side = lambda k: entries.select(F.col("sid").alias(k), F.col("n").alias("n" + k), F.col("bits").alias("bits" + k))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def each(batches):
        for batch in batches:
            na, nb, x, y = (batch.column(c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb"))
            keep = [(q + p) * differing(u, v) <= (q - p) * (m + n) for m, n, u, v in zip(na, nb, x, y)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return staged(both.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(each, "a bigint, b bigint"), "possible")


def _verified(pairs: DataFrame, entries: DataFrame, texts: DataFrame, shingle: int, least: tuple[int, int]) -> DataFrame:
    """The (a, b) of the distinct pairs that reach the similarity. Sets are made again, from the texts of pairs that are possible."""
    p, q = least
    left = _possible(pairs, entries, least)
    sides = left.select(F.col("a").alias("sid")).union(left.select(F.col("b").alias("sid")))
    wanted = staged(entries.select("sid", "t").join(sides.groupBy("sid").agg(F.count(F.lit(1)).alias("pairs")), "sid"), "wanted")
    mine = F.broadcast(wanted.select("sid", "t")) if wanted.count() <= MOST_SENT else wanted.select("sid", "t")
    sets = staged(_sets(texts.join(mine, "t").dropDuplicates(["sid"]).select("sid", "text"), shingle), "sets")
    # Of a pair, the one with more pairs is the hub.
    count = lambda k: wanted.select(F.col("sid").alias(k), F.col("pairs").alias("n" + k))
    first = F.col("na") >= F.col("nb")
    led = left.join(count("a"), "a").join(count("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("sid"))
    led = staged(led, "led")
    hubs = staged(led.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")), "led-hubs")
    share = F.pmod(F.xxhash64("sid"), F.col("shares")).cast("int")
    followers = led.join(hubs, "hub").select("hub", share.alias("share"), "sid").join(sets, "sid").select("hub", "share", F.lit(1).alias("kind"), "sid", "hs")
    leaders = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).join(sets.withColumnRenamed("sid", "hub"), "hub").select("hub", "share", F.lit(0).alias("kind"), F.col("hub").alias("sid"), "hs")
    both = leaders.union(followers).repartition("hub", "share").sortWithinPartitions("hub", "share", "kind")

    def each(batches):
        x = None  # the set of the hub that is being followed
        for batch in batches:
            a, b = [], []
            for hub, kind, sid, hs in zip(batch.column("hub").to_pylist(), batch.column("kind").to_pylist(), batch.column("sid").to_pylist(), batch.column("hs")):
                y = hs.values.to_numpy().view(np.uint64)
                if not kind:
                    x = y.copy()
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if q * shared >= p * (len(x) + len(y) - shared):
                    a.append(min(hub, sid))
                    b.append(max(hub, sid))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    out = staged(both.mapInArrow(each, "a bigint, b bigint"), "links")
    for x in (left, wanted, sets, led, hubs):
        dropped(x)
    return out


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: tuple[int, int] = LEAST, proposed: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id), one row for each row of df.

    component_id is the smallest doc_id in the connected component of pairs whose similarity is at least
    ``least``. ``proposed`` has (t, h): the texts with the xxhash64 t are in a group h of another method, and those of one group
    are compared like those of a key. Wordless texts are alike. Null ids and repeated rows are as in ``simhash.near_duplicates``; an
    empty table gives no rows. A text may be of any length.
    """
    p, q = least
    texts = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    rows = staged(_keyed(texts, shingle), "keyed")
    every = staged(rows.groupBy("sid").agg(*(F.first(c).alias(c) for c in ("t", "n", "bits", "short", "keys"))), "every")
    places = every.select(F.explode("keys").alias("h"), "sid")
    if proposed is not None:
        # Texts with equal sets are one entry here, but can be in several groups.
        places = places.union(staged(rows.select("t", "sid").distinct().join(proposed, "t").select("h", "sid").distinct(), "proposed"))
    sizes = staged(places.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "sizes")
    shared = staged(places.join(sizes, "h"), "shared")
    scores = staged(shared.groupBy("sid").agg(F.sum("c").alias("score")), "scores")
    entries = staged(every.drop("keys").join(scores, "sid"), "entries")
    now = staged(shared.select("h", "sid").join(entries.select("sid", "n", "short", "score"), "sid").select("h", F.struct("score", "sid").alias("rank"), "sid", "n", "short", F.col("sid").alias("root")), "now")
    for x in (every, sizes, shared, scores):
        dropped(x)
    apart = " + ".join(f"bit_count(short[{k}] ^ hub.short[{k}])" for k in range(SHORT // 64))
    near = f"root <> hub.root and {q} * least(n, hub.n) >= {p} * greatest(n, hub.n) and {q + p} * ({apart}) <= {q - p} * (n + hub.n)"
    pair = [F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")]
    linked, hubs_each = None, 1
    while True:
        # Keys whose texts are in more than one component; all pairs of the small ones are tested, once hubs have joined most.
        keys = now.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("h", "m")
        keys = staged(keys, "mixed")
        if keys.isEmpty():
            break
        some = staged(now.join(keys, "h"), "some")
        mine = F.struct("rank", "sid", "n", "short", "root").alias("hub")
        small = F.col("m") <= (MOST_EACH if linked is not None else 0)
        group = F.pmod(F.xxhash64("sid", F.lit(hubs_each)), F.lit(hubs_each)).alias("g")
        large = some.where(~small).drop("m")
        hubs = staged(large.groupBy("h", group).agg(F.max(mine).alias("hub")).select("h", "hub"), "hubs")
        pairs = large.join(hubs, "h").where(near).select(*pair)
        if linked is not None:
            few = some.where(small).drop("m")
            pairs = pairs.union(few.join(few.select("h", mine), "h").where(f"sid < hub.sid and {near}").select(*pair))
        pairs = staged(pairs.distinct(), "pairs")
        found = _verified(pairs, entries, texts.select("t", "text"), shingle, least)
        fresh = not found.isEmpty()
        linked = found if linked is None else staged(linked.union(found), "links") if fresh else linked
        rest = large.join(hubs.select("h", F.col("hub.sid").alias("sid")), ["h", "sid"], "left_anti")
        if fresh:
            roots = staged(components(linked), "roots").withColumnRenamed("node", "sid")
            rest = rest.drop("root").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        before, now = now, staged(rest.select("h", "rank", "sid", "n", "short", "root"), "now")
        for x in (before, keys, some, hubs, pairs):
            dropped(x)
        hubs_each *= 16
    dropped(entries)
    names = rows.select("doc_id", F.col("sid").alias("fp"))
    if linked is None:
        linked = df.sparkSession.createDataFrame([], "a bigint, b bigint")
    return grouped(names, components(linked)).select("doc_id", "component_id")
