"""Quality rules: a threshold table compiled into one expression.

Every statistic is a column expression over the row's own text, so the operator is a narrow map: no
shuffle, no user function, and no state that grows with the table.

Words are runs of characters other than space and \\x09-\\x0D. Windows of three words are compared by a
64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as are this be was or by from have at an not a i you "
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an er "
    "le la les de des et un une du en que qui dans pour sur par est pas au ce il elle avec "
    "el los las y del se por con una su para como al lo más o sus no"
).split()


@dataclass(frozen=True)
class Rule:
    """A text fails if numerator / denominator is below low or above high (either may be absent)."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def fails(self, of: str = "") -> str:
        """SQL; cross-multiplied, so that no ratio is rounded and a denominator of zero never divides."""
        top, under = of + self.numerator, of + self.denominator if self.denominator else "1"
        tests = [f"{top} < {self.low} * {under}"] if self.low is not None else []
        tests += [f"{top} > {self.high} * {under}"] if self.high is not None else []
        return " or ".join(tests)


#: The first two are the base rules.
BASE_RULES = (
    Rule("too_short", "n_words", low=50),
    Rule("repetitive", "n_repeat_words", "n_words", high=0.5),
)
METHOD_RULES = (
    Rule("word_length", "word_chars", "n_words", low=2, high=20),
    Rule("symbols", "n_symbols", "n_words", high=0.3),
    Rule("exclamations", "n_exclamations", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.04),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)

_PAIRS = "array<struct<h:bigint,i:int>>"


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds a value to a name once. Columns would be inlined at each use when a filter on the verdict is pushed down."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _metrics() -> dict[str, str]:
    """SQL of each statistic over x (text), w (words), l (lines with a word), p (places of repeated windows, in order)."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return {
        "n_words": "size(w)",
        "word_chars": "length(array_join(w, ''))",
        "n_symbols": "length(x) - length(regexp_replace(x, '[#*$%&|<>]+', ''))",
        "n_exclamations": "length(x) - length(replace(x, '!', ''))",
        "n_stop_words": f"size(filter(w, y -> y in ({stop})))",
        "n_lines": "size(l)",
        "n_dup_lines": "size(l) - size(array_distinct(l))",
        "n_repeat_words": "aggregate(p, named_struct('n', 0L, 'e', 0), (a, k) -> named_struct('n', a.n + (k + 3 - greatest(a.e, k)), 'e', k + 3), a -> a.n)",
    }


def measured(text: str, then: str) -> str:
    """SQL: the statistics of a text as struct q, in the expression ``then``."""
    q = "named_struct(" + ", ".join(f"'{k}', bigint({v})" for k, v in _metrics().items()) + ")"
    # Sorted (hash, place) pairs put equal windows side by side; most texts have none and skip the sort.
    repeated = "(k > 0 and s[greatest(k - 1, 0)].h = y.h) or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = y.h)"
    out = _let(q, "q", then)
    out = _let(f"sort_array(transform(filter(s, (y, k) -> {repeated}), y -> y.i))", "p", out)
    out = _let(f"if(size(array_distinct(h)) = size(h), cast(array() as {_PAIRS}), sort_array(transform(h, (y, i) -> named_struct('h', y, 'i', i))))", "s", out)
    out = _let("if(size(w) >= 3, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])), cast(array() as array<bigint>))", "h", out)
    out = _let(r"filter(split(x, '\n', -1), y -> y rlike r'[^\x20\x09-\x0D]')", "l", out)
    out = _let(r"array_remove(split(x, r'[\x20\x09-\x0D]+', -1), '')", "w", out)
    return _let(text, "x", out)


def quality_rules(df: DataFrame, text_col: str = "text", base=BASE_RULES, method=METHOD_RULES, out: str = "quality") -> DataFrame:
    """Add a struct column ``out``: the statistics, base_failed, kept, and failed (names of the rules that failed).

    One row out for each row in, other columns untouched; an existing column named ``out`` is replaced. A
    null or empty text has no words, so it fails ``too_short``. Repeated rows each get the same verdict. The
    text may be of any length: work is n log n in its words.
    """
    names = lambda rules: "array_compact(array(" + ", ".join(f"if({r.fails('q.')}, '{r.name}', null)" for r in rules) + "))"
    verdict = "named_struct(" + ", ".join(f"'{k}', q.{k}" for k in _metrics()) + ", 'base_failed', size(b) > 0, 'kept', size(b) = 0 and size(m) = 0, 'failed', concat(b, m))"
    then = _let(names(base), "b", _let(names(method), "m", verdict))
    return df.withColumn(out, F.expr(measured(f"coalesce(cast(`{text_col}` as string), '')", then)))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    q = quality_rules(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return q.select("doc_id", *(F.col(f"quality.{k}").alias(k) for k in names))


def _fails_sql(rules) -> str:
    return " OR ".join(r.fails() for r in rules)


OP7_SQL = rf"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
    FROM documents
), grams AS (
    SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), again AS (
    SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id
), m AS (
    SELECT doc_id, len(w) AS n_words, length(list_aggregate(w, 'string_agg', '')) AS word_chars,
        length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(x) - length(replace(x, '!', '')) AS n_exclamations,
        len(list_filter(w, lambda y: list_contains(['{"', '".join(dict.fromkeys(STOP_WORDS))}'], y))) AS n_stop_words,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM w LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
    ({_fails_sql(BASE_RULES)}) AS base_failed, NOT ({_fails_sql((*BASE_RULES, *METHOD_RULES))}) AS kept
FROM m
"""
