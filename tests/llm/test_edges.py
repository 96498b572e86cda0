"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from gradelake.llm.centroids import clustered
from gradelake.llm.chat_format import chat_format, read_back
from gradelake.llm.decontamination import contamination, without_documents, without_spans
from gradelake.llm.html_extract import extract
from gradelake.llm.license_scan import license_scan
from gradelake.llm.line_dedup import line_dedup
from gradelake.llm.packing import pack, public_vocabulary, sequences
from gradelake.llm.quality_rules import quality_rules
from gradelake.llm.resampling import resampled
from gradelake.llm.sharding import sharded
from gradelake.llm.simhash import near_duplicates
from gradelake.llm.token_counts import token_counts
from gradelake.llm.topk import top_k

LONG = "word and " * 30_000 + "\n" + "é漢🤦 " * 10_000
ROWS = [(1, "a b c\nd\ne\nf"), (1, "a b c\nd\ne\nf"), (1, "other text"), (None, "a b c\nd\ne\nf"), (None, None), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (5, LONG), (6, "\x00\x7f\n\n\n")]
SPOILERS = ["x", "w", "q", "n", "h", "fp", "node", "root", "digest", "items", "spans", "starts", "bits", "shard", "bytes", "length", "piece", "loss", "turns", "segments", "_rank", "gram"]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.select("*", *(F.lit(None).cast("string").alias(c) for c in SPOILERS))


def bench(spark):
    return spark.createDataFrame([(None, "d e f"), (1, None), (2, "..."), (3, "other")], "item_id bigint, text string")


def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


OPERATORS = {
    "near_duplicates": lambda s, df: near_duplicates(df),
    "contamination": lambda s, df: contamination(df, bench(s)),
    "sharded": lambda s, df: sharded(df, limit=1000),
    "license_scan": lambda s, df: license_scan(df),
    "extract": lambda s, df: extract(df, "doc_id", "x", "text"),
    "quality_rules": lambda s, df: quality_rules(df),
    "token_counts": lambda s, df: token_counts(df, model()),
    "line_dedup": lambda s, df: line_dedup(df, report="report"),
    "without_spans": lambda s, df: without_spans(df, bench(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_out_for_each_row_in(spark, name):
    out = OPERATORS[name](spark, frame(spark, ROWS)).collect()
    assert len(out) == len(ROWS)
    key = "page_id" if name == "extract" else "doc_id"
    assert sorted((r[key] for r in out), key=str) == sorted((r[0] for r in ROWS), key=str)


@pytest.mark.parametrize("name", [*OPERATORS, "pack", "without_documents"])
def test_empty_table(spark, name):
    more = {"pack": lambda s, df: pack(df, public_vocabulary()), "without_documents": lambda s, df: without_documents(df, bench(s))}
    assert (OPERATORS | more)[name](spark, frame(spark, [])).collect() == []


def test_empty_benchmark(spark):
    none = bench(spark).limit(0)
    assert {r.n_hit for r in contamination(frame(spark, ROWS), none).collect()} == {0}
    assert without_documents(frame(spark, ROWS), none).count() == len(ROWS)


def test_columns_survive(spark):
    df = frame(spark, ROWS)
    for out in (quality_rules(df).drop("quality"), line_dedup(df), without_documents(df, bench(spark)), without_spans(df, bench(spark))):
        assert out.columns == df.columns


def test_quality_replaces_its_own_column(spark):
    df = frame(spark, ROWS).withColumn("quality", F.lit(3))
    assert {r.quality.kept for r in quality_rules(df).collect()} == {False}


def test_pack_everything(spark):
    out = pack(frame(spark, ROWS), public_vocabulary())
    rows = out.collect()
    assert sum(r.piece == 0 for r in rows) == len(ROWS) and all(len(r.ids) == r.length for r in rows)
    assert [r.length for r in rows if r.doc_id == 3] == [1]
    seqs = sequences(out).collect()
    assert sum(len(r.ids) for r in seqs) == sum(r.length for r in rows) and max(len(r.ids) for r in seqs) <= 1024


def test_repeats_and_nulls_in_groups(spark):
    out = near_duplicates(frame(spark, ROWS)).collect()
    assert {r.component_id for r in out if r.fingerprint == "0" * 16} == {2}
    same = [r for r in out if r.doc_id in (1, None) and r.fingerprint != "0" * 16]
    assert {r.component_id for r in same} == {1}
    only_null = near_duplicates(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id bigint, text string")).collect()
    assert [r.component_id for r in only_null] == [None, None]


def test_line_dedup_of_repeated_rows(spark):
    out = line_dedup(frame(spark, ROWS), report="r").collect()
    null_first = [r for r in out if r.doc_id is None and r.text]
    assert null_first[0].text == "a b c\nd\ne\nf"
    assert [(r.text, r.r.n_removed) for r in out if r.doc_id == 1 and r.text != "other text"] == [("", 4), ("", 4)]
    assert [r.text for r in out if r.doc_id == 2] == [None]
    left = line_dedup(frame(spark, ROWS), drop_emptied=True)
    assert left.count() == len(ROWS) - 2


def test_chat_with_nulls_and_ties(spark):
    rows = [(1, 2, "user", None), (1, 2, "user", None), (1, None, None, "x"), (None, 0, "assistant", "<|im_sep|>"), (2, 0, "user\n<|", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(1))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_back(chat_format(df)).collect()}
    assert got == {1: [("", "x"), ("user", ""), ("user", "")], None: [("assistant", "<|im_sep|>")], 2: [("user\n<|", "")]}
    assert chat_format(df.limit(0)).collect() == []
    assert [r.turns for r in read_back(spark.createDataFrame([(None,), ("",)], "formatted string")).collect()] == [[], []]


def test_shards_of_identical_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("doc_id"), F.lit("x" * 100).alias("text"))
    sums = sharded(df, limit=1000).groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert sum(r.b for r in sums) == 50_000 and max(r.b for r in sums) <= 1000


def test_release(spark):
    from gradelake.llm.shared import release, staged

    release(spark)
    table = staged(spark.range(3), "x")
    assert table.count() == 3 and release(spark) == 1 and release(spark) == 0


@pytest.mark.parametrize("more", [["lang"], ["bytes", "depth", "row", "fine", "a.b"], ["shard", "Shard_1", "doc_id"]])
def test_written_shards(spark, tmp_path, more):
    from gradelake.llm.sharding import write_shards

    df = spark.createDataFrame(ROWS, "key bigint, text string").select("*", *(F.lit(c + "!").alias(c) for c in more))
    name = write_shards(df, str(tmp_path / "s"), "key", limit=1000)
    back = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "s"))
    assert back.columns == df.columns and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert name == ("shard_2" if "shard" in more else "shard")
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "s").glob(f"{name}=*"))


def test_columns_of_any_name(spark):
    """Names with dots and spaces, for ids and texts."""
    plain = spark.createDataFrame([(1, "a b c d"), (2, None)], "i bigint, t string")
    df = plain.toDF("my.id", "my text.of it")
    by = {"id_col": "my.id", "text_col": "my text.of it"}
    assert {r.doc_id for r in near_duplicates(df, **by).collect()} == {1, 2}
    assert {r.doc_id for r in contamination(df, bench(spark), **by).collect()} == {1, 2}
    assert {r.doc_id for r in pack(df, public_vocabulary(), **by).collect()} == {1, 2}
    assert {r.doc_id for r in token_counts(df, model(), **by).collect()} == {1, 2}
    assert {r.doc_id for r in license_scan(df, **by).collect()} == {1, 2}
    assert {r.doc_id for r in sharded(df, **by).collect()} == {1, 2}
    turns = spark.createDataFrame([(1, 0, "user", "x")], "c bigint, t int, r string, x string").toDF("c.c", "t.t", "r.r", "x.x")
    assert chat_format(turns, "c.c", "t.t", "r.r", "x.x").first().conv_id == 1
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (50, [2.0, 1.0])], "a bigint, b array<float>").toDF("a.a", "b b")
    assert top_k(vectors, F.col("vec_id") % 50 == 0, "a.a", "b b").count() == 2
    assert clustered(vectors, "a.a", "b b", dims=2).count() == 2
    assert resampled(df, bench(spark), **by).count() == 2
