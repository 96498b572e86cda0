"""Benchmark decontamination: normalised windows of the test items, looked up in every training text.

Only DataFrame and SQL functions. Words are runs of 0-9, A-Z (in lower case) and non-ASCII characters. An
item's windows are its runs of 13 words; an item of fewer is one window.

Any occurrence of a window of L words contains a whole aligned block of g = (L + 1) div 2 words, so each text
is first tested on its n div g aligned blocks against the hashes of all blocks in the benchmark. Only texts
with such a block have all their windows hashed; the windows found are then compared as text.

The sets are sent to the executors only while the benchmark has at most ``MOST_HASHES`` block and window
hashes, which is counted first. Beyond that, the windows of texts and items meet in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import staged

WINDOW = 13
MOST_HASHES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"r'[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


def _low(text: str) -> str:
    """SQL for a text with A-Z in lower case; `translate` makes an object for each character, so ASCII goes another way."""
    return f"if(octet_length({text}) = char_length({text}), lower({text}), translate({text}, '{_UPPER}', '{_LOWER}'))"


def words(text: str) -> str:
    """SQL for the words of a text, A-Z in lower case. A text that isn't all ASCII is split first, since few of its words need `translate`."""
    text = f"coalesce({text}, '')"
    return f"array_remove(if(octet_length({text}) = char_length({text}), split(lower({text}), {_BETWEEN}, -1), transform(split({text}, {_BETWEEN}, -1), x -> {_low('x')})), '')"


def _hash(array: str, at: str, n: int) -> str:
    return f"xxhash64(slice({array}, {at} + 1, {n}))"


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds a value to a name once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spans(n: str, k: int) -> str:
    return f"if({n} >= {k}, sequence(0, {n} - {k}), cast(array() as array<int>))"


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(gram, len, items): each different window with the sorted ids, as strings, of the items that have it."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), F.expr(words("cast(text as string)")).alias("w")).where("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(window)))
    grams = w.select("item", "len", F.explode(F.expr("array_distinct(transform(sequence(0, size(w) - len), i -> array_join(slice(w, i + 1, len), ' ')))")).alias("gram"))
    return grams.groupBy("gram", "len").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Add _n (words) and _hits (array of pos, len, gram) whose hashes are in the table."""
    spark = docs.sparkSession
    lengths = [r["len"] for r in table.select("len").distinct().orderBy("len").collect()]  # at most `window` rows
    none = "cast(array() as array<struct<pos:int,len:int,gram:string>>)"
    docs = docs.withColumn("_f", F.expr(words("_text")))
    near, found = [], []
    split = table.withColumn("w", F.split("gram", " "))
    hashes = []
    for n in lengths:
        g = (n + 1) // 2
        one = split.where(F.col("len") == n)
        hashes.append(one.select(F.lit(n).alias("len"), F.lit(True).alias("block"), F.explode(F.expr(f"transform(sequence(0, {g - 1}), i -> {_hash('w', 'i', g)})")).alias("h")))
        hashes.append(one.select(F.lit(n).alias("len"), F.lit(False).alias("block"), F.expr(_hash("w", "0", n)).alias("h")))
    sets: dict[tuple[int, bool], list[int]] = {}
    for part in hashes:
        for r in part.distinct().collect():  # counted before: within MOST_HASHES
            sets.setdefault((r["len"], r["block"]), []).append(r["h"])
    for n in lengths:
        g = (n + 1) // 2
        blocks, grams = (", ".join(f"{x}L" if x > -(1 << 63) else f"bigint({x})" for x in sets[n, b]) for b in (True, False))
        near.append(f"exists(if(size(_f) >= {g}, sequence(0, size(_f) div {g} - 1), cast(array() as array<bigint>)), k -> {_hash('_f', f'int(k * {g})', g)} in ({blocks}))")
        found.append(f"transform(filter({_spans('size(_w)', n)}, i -> {_hash('_w', 'i', n)} in ({grams})), i -> named_struct('pos', i, 'len', {n}, 'gram', array_join(slice(_w, i + 1, {n}), ' ')))")
    if not lengths:
        return docs.select("*", F.size("_f").alias("_n"), F.expr(none).alias("_hits")).drop("_f")
    docs = docs.withColumn("_near", F.expr(" or ".join(near)))
    docs = docs.withColumn("_w", F.expr("if(_near, _f, null)"))
    docs = docs.withColumn("_hits", F.expr(f"if(_near, flatten(array({', '.join(found)})), {none})"))
    return docs.withColumn("_n", F.size("_f")).drop("_f", "_w", "_near")


def _joined_hits(docs: DataFrame, table: DataFrame) -> DataFrame:
    """As _hits, for a benchmark too large to send: block hashes of all texts meet those of the items in a shuffled join, then the windows of the texts that are left do, as text."""
    docs = docs.withColumn("_f", F.expr(words("_text"))).withColumn("_digest", F.sha2(F.coalesce("_text", F.lit("")), 256))
    lengths = [r["len"] for r in table.select("len").distinct().orderBy("len").collect()]
    none = "cast(array() as array<struct<pos:int,len:int,gram:string>>)"
    if not lengths:
        return docs.select("*", F.size("_f").alias("_n"), F.expr(none).alias("_hits")).drop("_f", "_digest")
    split = table.withColumn("f", F.split("gram", " "))
    theirs, mine = None, []
    for n in lengths:
        g = (n + 1) // 2
        one = split.where(F.col("len") == n).select(F.lit(n).alias("len"), F.explode(F.expr(f"transform(sequence(0, {g - 1}), i -> {_hash('f', 'i', g)})")).alias("h"))
        theirs = one if theirs is None else theirs.union(one)
        mine.append(f"transform(if(size(_f) >= {g}, sequence(0, size(_f) div {g} - 1), cast(array() as array<bigint>)), k -> named_struct('len', {n}, 'h', {_hash('_f', f'int(k * {g})', g)}))")
    blocks = docs.select("_digest", F.explode(F.expr(f"array_distinct(flatten(array({', '.join(mine)})))")).alias("x")).select("_digest", "x.len", "x.h")
    # Right sides are written first: then both sides of a join are plain exchanges, and a digest or block that many texts share can be split.
    near = staged(blocks.join(staged(theirs.distinct(), "blocks"), ["len", "h"], "left_semi").select("_digest").distinct(), "near")
    left = docs.select("_digest", "_text").join(near, "_digest", "left_semi").dropDuplicates(["_digest"]).withColumn("_w", F.expr(words("_text")))
    grams = ", ".join(f"transform({_spans('size(_w)', n)}, i -> named_struct('pos', i, 'len', {n}, 'gram', array_join(slice(_w, i + 1, {n}), ' ')))" for n in lengths)
    every = left.select("_digest", F.explode(F.expr(f"flatten(array({grams}))")).alias("x")).select("_digest", "x", F.col("x.gram").alias("gram"))
    per = staged(every.join(table.select("gram"), "gram", "left_semi").groupBy("_digest").agg(F.collect_list("x").alias("_hits")), "places")
    return docs.withColumn("_n", F.size("_f")).drop("_f").join(per, "_digest", "left").withColumn("_hits", F.coalesce("_hits", F.expr(none))).drop("_digest")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least: int = 20, most_hashes: int = MOST_HASHES) -> DataFrame:
    """(doc_id, digest, n_words, n_hit, items, spans, contaminated), one row for each row of docs.

    n_hit counts words inside occurrences of windows, items are the ids (as strings, sorted) whose windows
    occur, spans the merged ranges [s, e) of hit words, digest the SHA-256 of the text where there is a hit.
    contaminated: n_hit > 0 and least * n_hit >= n_words. Null and empty texts have no words; items without
    words have no window; null ids are kept (a null item id is left out of items). Repeated rows and copies
    are looked up once and returned as often as they stand. Empty tables give no rows, or no hits. A text may be of any
    length: work is linear in its words.
    """
    table = windows(benchmark.select("item_id", "text"), window)
    # (window + 1) div 2 blocks and one window for each gram at most, and the ids that are sent with them.
    size = table.agg(F.count(F.lit(1)).alias("grams"), F.sum(F.size("items")).alias("ids")).first()
    small = size["grams"] * ((window + 1) // 2 + 1) + (size["ids"] or 0) <= most_hashes
    table = staged(table.coalesce(8) if small else table, "windows")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = (_hits if small else _joined_hits)(rows, table)
    rows = rows.select("doc_id", F.col("_n").cast("bigint").alias("n_words"), F.expr("if(size(_hits) > 0, sha2(_text, 256), null)").alias("digest"), "_hits")
    rows = staged(rows, "hits")
    hit = rows.where("digest is not null")
    places = hit.select("digest", "_hits").dropDuplicates(["digest"]).select("digest", F.explode("_hits").alias("x")).select("digest", "x.pos", "x.len", "x.gram")
    real = places.join(F.broadcast(table.drop("len")) if small else table.drop("len"), "gram")
    # Hit words in order; a span starts at one whose predecessor isn't hit, and ends before one that isn't.
    ends = "transform(filter(sequence(0, size(w) - 1), i -> i = {}), i -> w[i]{})"
    starts, stops = ends.format("0 or w[i - 1] <> w[i] - 1", ""), ends.format("size(w) - 1 or w[i + 1] <> w[i] + 1", " + 1")
    zipped = "zip_with({}, {}, (s, e) -> named_struct('s', s, 'e', e))"
    covered = "array_sort(array_distinct(flatten(transform(_s, x -> sequence(x.s, x.s + x.n - 1)))))"
    per = real.groupBy("digest").agg(F.collect_set(F.expr("named_struct('s', pos, 'n', len)")).alias("_s"), F.expr("array_sort(array_distinct(flatten(collect_set(items))))").alias("items"))
    per = per.select("digest", "items", F.expr(_let(covered, "w", f"named_struct('n', bigint(size(w)), 'spans', {zipped.format(starts, stops)})")).alias("_c")).select("digest", "items", F.col("_c.spans").alias("spans"), F.col("_c.n").alias("n_hit"))
    per = staged(per, "per")
    found = hit.drop("_hits").join(per, "digest", "left")
    clean = rows.where("digest is null").select("doc_id", "n_words", F.lit(None).cast("string").alias("digest"))
    out = found.unionByName(clean, allowMissingColumns=True)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        "doc_id", "digest", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<s:int,e:int>>)")).alias("spans"),
        ((n_hit > 0) & (least * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


#: Rows of (digest, spans) that are sent to all executors at most.
MOST_SENT = 200_000


def _by_digest(found: DataFrame, *columns: str) -> DataFrame:
    table = staged(found.select("digest", *columns).dropDuplicates(["digest"]), "digests")
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    """Each row as a struct beside its text and the digest of that, so that no column can meet one of these."""
    text = F.col(f"row.`{text_col}`").cast("string")
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", text.alias("text"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("mine"))


def without_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, whatever their names.

    Null and empty texts have no words and stay; rows of equal texts stay or go together, repeated rows and null ids
    like any other; empty tables give no rows, or leave all. A text may be of any length.
    """
    rows = _rows(docs, text_col)
    bad = _by_digest(contamination(rows.select(F.lit(0).alias("doc_id"), "text"), benchmark, **options).where("contaminated"))
    return rows.join(bad, F.col("mine") == F.col("digest"), "left_anti").select("row.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All rows of docs; in contaminated texts, hit words go, each with the separators after it. Work is linear in words and spans.

    Null and empty texts stay as they are; rows of equal texts are cut alike; other columns are untouched,
    whatever their names; empty tables give no rows, or leave all.
    """
    rows = _rows(docs, text_col)
    bad = _by_digest(contamination(rows.select(F.lit(0).alias("doc_id"), "text"), benchmark, **options).where("contaminated"), "spans")
    out = rows.join(bad, F.col("mine") == F.col("digest"), "left")
    sep, word = r"[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]", r"[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
    hit = "flatten(transform(spans, m -> sequence(m.s, m.e - 1)))"
    left = _let(f"regexp_extract_all(text, '{word}+{sep}*', 0)", "p", f"array_join(transform(array_except(sequence(0, size(p) - 1), {hit}), i -> p[i]), '')")
    cut = F.expr(f"if(spans is null, row.`{text_col}`, concat(regexp_extract(text, '^{sep}*', 0), {left}))")
    return out.select(*(cut.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _sql_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words("text")} AS w FROM benchmark),
grams AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), {WINDOW}) AS n FROM b WHERE len(w) > 0))),
places AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN grams USING (g)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
