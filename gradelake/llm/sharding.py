"""Sharding by extendible hashing.

A shard is a prefix of a document's hash bits. The directory starts with the empty prefix; only a shard over
its byte limit is divided on one more bit, so a document's shard is its shortest prefix whose documents fit.

Byte sums are taken once per fine prefix (a partial aggregate) and rolled up a few levels at a time, as long
as buckets fit; fine prefixes that are still too large go to a deeper round. The directory grows with total bytes / limit and
never with the number of documents, and stays a distributed table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import dropped, staged

SHARD_BYTES = 16 << 20
#: Levels that are rolled up at a time.
STEP = 4
_NIBBLES = ", ".join(f"'{i:x}', '{i:04b}'" for i in range(16))


def _bits(hexadecimal: str) -> str:
    return f"array_join(transform(split({hexadecimal}, ''), c -> element_at(map({_NIBBLES}), c)), '')"


def _rolled(sums: DataFrame, depth: int, least: int, limit: int) -> DataFrame:
    """(fine, shard) for each fine prefix of ``depth`` bits; shard is null if even that prefix is too large.

    sums: (fine, bytes, n). A few levels are rolled up at a time, so a prefix gathers at most 2^STEP rows, and only
    prefixes that fit go on: a bucket over its limit has none above it that isn't. The rise ends at ``least``
    bits. A single document over the limit can't be divided and gets a shard of its own.
    """
    fits = "(bytes <= {limit}L or n = 1)".format(limit=limit)
    book = staged(sums.select("fine", F.col("fine").alias("shard"), F.expr(f"not {fits}").alias("over")), "book")
    level = staged(sums.select(F.col("fine").alias("p"), "bytes", "n", F.expr(f"not {fits}").alias("over")), "level")
    while depth > least:
        low = max(least, depth - STEP)
        up = level.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn("up", F.expr("substring(p, 1, d)"))
        sizes = staged(up.groupBy("up").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.bool_or("over").alias("over")).select("up", "bytes", "n", F.expr(f"over or not {fits}").alias("over")), "sizes")
        best = staged(up.where("not over").select("p", "d", "up").join(sizes.where("not over").select("up"), "up").groupBy("p").agg(F.min("d").alias("d")).select("p", F.expr("substring(p, 1, d)").alias("best")), "best")
        new = staged(book.join(best, F.col("shard") == F.col("p"), "left").select("fine", F.coalesce("best", "shard").alias("shard"), "over"), "book")
        level = staged(sizes.where(F.length("up") == low).select(F.col("up").alias("p"), "bytes", "n", "over"), "level")
        dropped(book)
        book, depth = new, low
        if level.where("not over").isEmpty():
            break
    return book.select("fine", F.when(~F.col("over"), F.col("shard")).alias("shard"))


def _assigned(df: DataFrame, id_col: str, text_col: str, limit: int, keep: list[str]) -> DataFrame:
    """(doc_id, row, bytes, shard) for each row; row is a struct of the columns to keep."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    mine = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(0)
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("x"), mine.alias("row"))
    rows = rows.select("doc_id", "row", F.octet_length("x").cast("bigint").alias("bytes"), F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), "x")).alias("h"), F.monotonically_increasing_id().alias("number"))
    # The number of a row is fixed by writing it down.
    rows = staged(rows, "sizes").select("doc_id", "row", "bytes", F.expr(_bits("concat(h, md5(cast(number as string)))")).alias("bits"))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    least, depth = 0, max(STEP, math.ceil(math.log2(total / limit)) + 4 if total else 0)
    out, left = None, rows
    while True:
        cut = left.withColumn("fine", F.substring("bits", 1, depth))
        sums = staged(cut.groupBy("fine").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")), "sums")
        book = staged(_rolled(sums, depth, least, limit), "directory")
        part = cut.join(book.where("shard is not null"), "fine").select("doc_id", "row", "bytes", "shard")
        out = part if out is None else out.union(part)
        large = book.where("shard is null")
        if large.isEmpty():
            return out
        left = cut.join(large.select("fine"), "fine", "left_semi").drop("fine")
        least, depth = depth + 1, min(depth + 8, 256)


def sharded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, bytes, shard, depth) for each row: bytes of the text in UTF-8, shard a string of 0 and 1.

    Every shard holds at most ``limit`` bytes, but for single documents that are larger by themselves. The
    hash is MD5 of id and text, so rows that repeat an id spread; rows that repeat both share all these
    bits, and bits of a number given to each row follow. Null texts hold 0 bytes and null ids hash as
    empty. Other columns are ignored; an empty table gives no rows. A text may be of any length.
    """
    return _assigned(df, id_col, text_col, limit, []).select("doc_id", "bytes", "shard", F.length("shard").alias("depth"))


#: Tasks that shards are written by at most.
MOST_TASKS = 100_000


def write_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> str:
    """Write all columns as Parquet, one folder and one file for each shard: path/shard=<bits>/. A shard fits its limit, and so one task.

    Columns keep their names and values, whatever they are; where one is called shard, the folders are named
    shard_1, or by the next free number. Returns that name. Nulls, repeats and the empty table are as in ``sharded``.
    """
    taken, name = {c.lower() for c in df.columns}, "shard"
    while name in taken:
        name = f"shard_{int(name.partition('_')[2] or 0) + 1}"
    out = _assigned(df, id_col, text_col, limit, df.columns).select("row.*", F.col("shard").alias(name))
    # As many tasks as shards, so that each is written by itself, however many there are.
    shards = _assigned(df, id_col, text_col, limit, []).select("shard").distinct().count()
    out.repartition(max(1, min(shards, MOST_TASKS)), name).write.mode("overwrite").partitionBy(name).parquet(path)
    return name


#: The limit of the query, small enough that its shards split on small tables too.
QUERY_BYTES = 64 << 10


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), limit=QUERY_BYTES)


OP4_SQL = f"""
WITH sized AS (
    SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')) AS h
    FROM documents
), hashed AS (
    SELECT doc_id, bytes, array_to_string(list_transform(string_split(h, ''), lambda c: MAP {{{", ".join(f"'{i:x}': '{i:04b}'" for i in range(16))}}}[c]), '') AS bits FROM sized
), prefixes AS (
    SELECT doc_id, bytes, d, substr(bits, 1, d) AS prefix FROM hashed, (SELECT CAST(unnest(range(0, 65)) AS INTEGER) AS d)
), fit AS (
    SELECT prefix FROM prefixes GROUP BY prefix HAVING sum(bytes) <= {QUERY_BYTES} OR count(*) = 1
)
SELECT doc_id, any_value(bytes) AS bytes, min_by(prefix, d) AS shard, min(d) AS depth FROM prefixes SEMI JOIN fit USING (prefix) GROUP BY doc_id
"""
