"""Line deduplication with overlapping windows of three lines.

Windows run over the lines that aren't blank. A window that occurs more than once in the table stays where it
comes first (by document id, then text hash, then line) and covers three lines to remove everywhere else;
overlapping windows cover their union. Windows are told apart by two 64-bit hashes of their lines.

Only the hashes are shuffled. First occurrences come from a min aggregate, which is combined before the
shuffle, so a passage that a third of all documents share sends one row per task. The repeated windows are
written before the join that finds their other occurrences, so that both its sides are plain exchanges, which
adaptive execution splits where one window is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.llm.shared import staged

#: Places to remove that are sent to all executors at most; beyond, documents are shuffled to them.
MOST_SENT = 1_000_000


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _t, gone, emptied): for each document with repeats, the places of the lines to remove among all its lines, and whether only blank ones are left; _t hashes the text."""
    text = f"cast(`{text_col}` as string)"
    filled = r"filter(transform(l, (x, i) -> named_struct('x', x, 'i', i)), y -> y.x rlike r'[^\x20\x09-\x0D]')"
    one = "named_struct('a', f[j].i, 'b', f[j + 1].i, 'c', f[j + 2].i, 'h1', xxhash64(f[j].x, f[j + 1].x, f[j + 2].x), 'h2', xxhash64(1, f[j + 2].x, f[j + 1].x, f[j].x), 'n', size(f))"
    every = _let(f"split({text}, '\\n', -1)", "l", _let(filled, "f", f"if(size(f) >= 3, transform(sequence(0, size(f) - 3), j -> {one}), null)"))
    # The text is hashed before the rows are exploded, else it would be once for each of them.
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.expr(text)).alias("_t"), F.expr(every).alias("w")).select("doc_id", "_t", F.explode("w").alias("w"))
    found = staged(rows.select("doc_id", "_t", "w.*"), "lines")
    many = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "_t", "a")).alias("first")).where("m > 1").drop("m")
    # Written first, so that both sides of the join are plain exchanges and a hot window can be split.
    later = found.join(staged(many, "many"), ["h1", "h2"]).where("not (named_struct('doc_id', doc_id, '_t', _t, 'a', a) <=> first)")
    per = later.groupBy("doc_id", "_t").agg(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b", "c")))).alias("gone"), F.max("n").alias("n"))
    return per.select("doc_id", "_t", "gone", (F.size("gone") == F.col("n")).alias("emptied"))


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds a value to a name once; a column would be made anew at each place of an inner function."""
    return f"transform(array({value}), {name} -> {body})[0]"


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: str | None = None, drop_emptied: bool = False) -> DataFrame:
    """All rows of df with repeated lines taken out of the text; other columns are untouched, whatever their names.

    ``report`` names a struct column (n_lines, n_removed) to add; one of that name is replaced. drop_emptied
    leaves out documents that lose all their non-blank lines. Blank lines stay. A null text stays null, and a
    text of fewer than three non-blank lines as it is. Rows that repeat id and text are one document: they
    lose the same lines. Null ids come first in order. An empty table gives no rows. Texts may have any
    number of lines; work is linear in them.
    """
    out = cleaned(df, id_col, text_col, drop_emptied)
    n_lines = F.expr(f"bigint(greatest(size(split(cast(row.`{text_col}` as string), '\\n', -1)), 0))")
    counts = [F.struct(n_lines.alias("n_lines"), F.col("removed").alias("n_removed")).alias(report)] if report else []
    kept = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns if c != report]
    return out.select(*kept, *counts)


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """(row, text, removed): each row of df as a struct, its new text and the number of lines removed."""
    text = f"cast(row.`{text_col}` as string)"
    places = staged(repeated_lines(df, id_col, text_col), "places")
    size = places.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    if size <= MOST_SENT:
        places = F.broadcast(places)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    out = rows.join(places, F.col(f"row.`{id_col}`").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.expr(text)) == F.col("_t")), "left")
    if drop_emptied:  # a stored column: a filter on the new text would be inlined by the optimizer
        out = out.where("not (emptied <=> true)")
    left = _let(f"split({text}, '\\n', -1)", "l", "array_join(transform(array_except(sequence(0, size(l) - 1), gone), i -> l[i]), '\\n')")
    return out.select("row", F.expr(f"if(gone is null, row.`{text_col}`, {left})").alias("text"), F.expr("bigint(coalesce(size(gone), 0))").alias("removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, report="_report").select("doc_id", "_report.n_lines", "_report.n_removed", "text")


OP10_SQL = r"""
WITH lines AS (
    SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM documents
), filled AS (
    SELECT doc_id, i, line, row_number() OVER w AS j, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
    SELECT doc_id, j, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, j) AS k FROM filled WHERE l3 IS NOT NULL
), gone AS (
    SELECT DISTINCT doc_id, j + d AS j FROM numbered, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1
), kept AS (
    SELECT l.doc_id, l.i, l.line, g.j IS NOT NULL AS out
    FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.i = f.i LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.j = g.j
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (out) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '') AS text
FROM kept GROUP BY doc_id
"""
