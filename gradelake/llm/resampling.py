"""Resampling of documents towards a target distribution, by hashed n-grams.

Features are runs of one to three words; a feature's bucket is its CRC-32 modulo ``BUCKETS``. A bucket's gain is the
logarithm of how much more frequent it is in the target than in the documents; a document's weight is the sum of
its features' gains. Gumbel noise by a hash of the id is added, and the highest scores are drawn.

Only DataFrame and SQL functions. The buckets of the runs that start at each word are written once, a row for each word.
Spark counts them for the gains, sums the gains by text, and ranks the scores in ranges of their order. Texts are split
in pieces of bounded size, with the two words after a piece beside it, so that no run is lost where a text is cut.

``bucket_counts`` gives the same counts of a few texts in one process, by DuckDB. No query uses it; tests do.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm.decontamination import words
from gradelake.llm.shared import dropped, staged

BUCKETS, LONGEST_RUN = 10_000, 3
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
#: Characters of a text that are split into words at once, about; longer texts are cut.
PIECE = 1 << 18
#: Documents that one range of ranks holds at most, about.
RANGE = 1 << 20

_IN, _BETWEEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # texts are cut as they are, with capitals
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"
#: Buckets of the runs that start at each word of a piece; a run that ends beyond the text has none.
_GRAMS = f"""
WITH lists AS MATERIALIZED (SELECT doc, piece, {_WORDS % "body"} AS own, {_WORDS % "after"} AS more FROM pieces),
words AS (SELECT doc, piece, len(own) AS n, unnest(own || more) AS w, generate_subscripts(own || more, 1) AS i FROM lists),
runs AS (SELECT doc, n, i, w, lead(w) OVER following AS w2, lead(w, 2) OVER following AS w3 FROM words WINDOW following AS (PARTITION BY doc, piece ORDER BY i))
SELECT doc, bucket(w) AS b1, bucket(w || ' ' || w2) AS b2, bucket(w || ' ' || w2 || ' ' || w3) AS b3 FROM runs WHERE i <= n"""
_SPACE, _NEXT = re.compile(_BETWEEN), re.compile(f"{_IN}+")


def _buckets(strings: pa.Array) -> pa.Array:
    """CRC-32 of each string's UTF-8 bytes, modulo BUCKETS."""
    strings = (strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings).cast(pa.binary())
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = memoryview(strings.buffers()[2] or b"")
    return pa.array([zlib.crc32(data[a:b]) % BUCKETS for a, b in zip(ends, ends[1:])], pa.int32())


def database():
    """A DuckDB in memory that writes no files, with the function ``bucket``. A null has no bucket."""
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "memory_limit": "512MB"})
    con.create_function("bucket", _buckets, ["VARCHAR"], "INTEGER", type="arrow")
    return con


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[str, str]]:
    """(piece, the words after it that its last runs reach) of a text, cut between words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        after, p, start = [], end, len(text)
        while len(after) < LONGEST_RUN - 1 and (m := _NEXT.search(text, p)):
            start = min(start, m.start())
            after.append(m[0])
            p = m.end()
        yield text[at:end], " ".join(after)
        at = start  # what has no words is left out, so it is searched once


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts."""
    k, n = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    starts = np.flatnonzero(np.diff(k, prepend=-1))
    return k[starts], np.add.reduceat(n, starts) if len(starts) else n


def bucket_counts(con, texts: list[str | None], size: int = PIECE) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(words of each text, its buckets in order, how often it has each)."""
    words, keys, counts = np.zeros(len(texts), np.int64), [], []

    def ran(part: list[tuple[int, int, str, str]]) -> None:
        doc, piece, body, after = zip(*part)
        con.register("pieces", pa.table({"doc": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int64()), "body": pa.array(body, pa.string()), "after": pa.array(after, pa.string())}))
        out = con.sql(_GRAMS).to_arrow_table()
        con.unregister("pieces")
        doc = out.column("doc").to_numpy()
        np.add.at(words, doc, 1)
        found = []
        for b in ("b1", "b2", "b3"):
            there = out.column(b).is_valid().to_numpy()
            found.append(doc[there] * BUCKETS + out.column(b).drop_null().to_numpy())
        k, n = np.unique(np.concatenate(found), return_counts=True)
        keys.append(k)
        counts.append(n)
        if len(keys) > 100:  # a long text has many pieces, but no more keys than there are buckets
            keys[:], counts[:] = zip(_summed(keys, counts))

    part, held = [], 0
    for i, text in enumerate(texts):
        for k, (body, after) in enumerate(pieces(text or "", size)):
            part.append((i, k, body, after))
            held += len(body)
            if held >= size:
                ran(part)
                part, held = [], 0
    if part:
        ran(part)
    k, n = _summed(keys, counts)
    cuts = np.searchsorted(k, np.arange(1, len(texts)) * BUCKETS)
    return words, np.split(k % BUCKETS, cuts), np.split(n, cuts)


def _cut(text: str, size: int) -> str:
    """SQL for the pieces of a text, as structs of ``body`` and ``after``, cut behind the word that ``size`` characters end in. No quantifier gives back what it took, so the pattern runs without recursion."""
    found = lambda group: rf"regexp_extract_all({text}, r'(?s)(.{{1,{size}}}+{_IN}*+)(?={_BETWEEN}*+({_IN}*+){_BETWEEN}*+({_IN}*+))', {group})"
    cut = f"zip_with({found(1)}, zip_with({found(2)}, {found(3)}, (a, b) -> concat(a, ' ', b)), (x, y) -> named_struct('body', x, 'after', y))"
    return f"if(octet_length({text}) <= {size}, array(named_struct('body', {text}, 'after', '')), {cut})"


def counted(df: DataFrame, id_col: str, text_col: str, name: str, size: int = PIECE) -> DataFrame:
    """The written table of (row, doc_id, b1, b2, b3): for each word of a text the buckets of the runs of 1, 2 and 3 words that start there, null for those that end beyond the text.

    ``row`` tells the rows of df apart; a piece without words has a row of nulls.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = rows.select("row", "doc_id", F.inline(F.expr(_cut("text", size)))).withColumn("own", F.expr(words("body")))
    parts = parts.select("row", "doc_id", F.size("own").alias("n"), F.expr(f"if(after = '', own, concat(own, {words('after')}))").alias("w"))
    runs = parts.select("row", "doc_id", F.inline_outer(F.expr("arrays_zip(slice(w, 1, n), slice(w, 2, n), slice(w, 3, n))")).alias("w1", "w2", "w3"))
    runs = runs.select("row", "doc_id", "w1", F.expr("w1 || ' ' || w2").alias("two"), "w3")
    bucket = lambda run: F.expr(f"int(crc32({run}) % {BUCKETS})")
    return staged(runs.select("row", "doc_id", bucket("w1").alias("b1"), bucket("two").alias("b2"), bucket("two || ' ' || w3").alias("b3")), name)


def _totals(counts: DataFrame) -> np.ndarray:
    """How often each bucket is in all texts."""
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.select(F.explode(F.array("b1", "b2", "b3")).alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    all_s, all_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighted(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document."""
    every = f"cast(split('{','.join(map(str, gain.tolist()))}', ',') as array<bigint>)"  # folded into one literal
    own = counts.withColumn("gain", F.expr(" + ".join(f"coalesce({every}[{b}], 0)" for b in ("b1", "b2", "b3"))))
    n_features = F.count("b1") + F.count("b2") + F.count("b3")
    return own.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), n_features.alias("n_features"), F.sum("gain").alias("weight")).drop("row")


def _ordered(scored: DataFrame, n: int) -> DataFrame:
    """Add rank from 1 by descending score, then doc_id, nulls last: ranges are sorted and written, and the counts of those before shift a range's places."""
    row = F.monotonically_increasing_id()
    ranges = max(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]  # the row spreads repeats of one document
    dealt = scored.withColumn("row", row).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = staged(dealt.drop("row").withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33).cast("int")
    before, at = {}, 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row for each range
        before[r.part], at = at, at + r["count"]
    if not before:
        return placed.withColumn("rank", F.lit(None).cast("bigint")).drop("place")
    shift = scored.sparkSession.createDataFrame(list(before.items()), "part int, before bigint")
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(shift), "part").withColumn("rank", F.col("before") + inside + 1).drop("part", "before", "place")


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those that aren't drawn.

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100) are drawn. Null, empty and wordless
    texts have no features and a weight of 0; texts may be of any length. Ties in the score go to the smaller id,
    nulls last; a null id hashes as an empty text. Repeated rows count and are ranked one by one. An empty table
    gives no rows; an empty target is one without features. Other columns aren't read.
    """
    theirs = counted(target, target_id, target_text, "target-counts")
    mine = counted(df, id_col, text_col, "counts")
    gain = gains(_totals(mine), _totals(theirs))
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((hashed.cast("double") + 0.5) / 4294967296.0)))
    scored = staged(_weighted(mine, gain).withColumn("score", F.col("weight") + noise), "scored")
    dropped(mine)
    dropped(theirs)
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    ranked = _ordered(scored.where(enough), n).withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    out = ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    """CRC-32 bit by bit: each byte is taken in, then eight shifts follow, which -1 stands for."""
    grams = lambda table, key: f"""SELECT {key} AS doc, unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3]) AS f FROM (
        SELECT {key}, w, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT {key}, {_WORDS % "text"} AS l FROM {table})) WINDOW x AS (PARTITION BY {key} ORDER BY i))"""  # noqa: E731
    return f"""WITH d AS MATERIALIZED (SELECT doc, f, count(*) AS n FROM ({grams("documents", "doc_id")}) WHERE f IS NOT NULL GROUP BY ALL),
    t AS MATERIALIZED (SELECT f, count(*) AS n FROM ({grams("benchmark", "item_id")}) WHERE f IS NOT NULL GROUP BY ALL),
    crc AS MATERIALIZED (SELECT f, xor(list_reduce(flatten(list_transform(range(1, len(h), 2), lambda i: [(strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, 4294967295), 4294967295) % {BUCKETS} AS b
        FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM t))),
    s AS (SELECT b, sum(n) AS s FROM d JOIN crc USING (f) GROUP BY b),
    u AS (SELECT b, sum(n) AS t FROM t JOIN crc USING (f) GROUP BY b),
    whole AS (SELECT (SELECT coalesce(sum(n), 0) FROM d) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
    gain AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST(coalesce(u.t, 0) + 1 AS DOUBLE) * CAST(whole.s + {BUCKETS} AS DOUBLE) / (CAST(s.s + 1 AS DOUBLE) * CAST(whole.t + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g FROM s LEFT JOIN u USING (b), whole),
    per AS (SELECT doc, sum(n) AS n_features, sum(n * g) AS weight FROM d JOIN crc USING (f) JOIN gain USING (b) GROUP BY doc),
    scored AS (SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score,
        coalesce(len({_WORDS % "text"}), 0) >= {LEAST_WORDS} AS enough FROM documents LEFT JOIN per ON doc = doc_id),
    placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE enough)
    SELECT scored.doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""


OP13_SQL = _sql()
