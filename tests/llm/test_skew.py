"""Joins whose one key holds most rows are split by adaptive execution, and long or deep inputs stay linear."""

import time

import pytest
from pyspark.sql import functions as F

from gradelake.llm import line_dedup
from gradelake.llm.decontamination import contamination, without_spans

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k",
}


@pytest.fixture
def small_parts(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_window_is_split(spark, small_parts):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one\ntwo\nthree\n"), F.col("id").cast("string")).alias("text")).repartition(8)
    found = line_dedup.repeated_lines(docs)
    assert found.count() == 19_999
    found.collect()
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()


def test_many_lines_in_one_text(spark):
    lines = "\n".join(f"line {i % 50_000} of it" for i in range(100_000))
    df = spark.createDataFrame([(1, lines), (2, "a\nb")], "doc_id bigint, text string").cache()
    df.count()
    start = time.perf_counter()
    rows = {r.doc_id: r.r for r in line_dedup.line_dedup(df, report="r").collect()}
    assert time.perf_counter() - start < 60 and (rows[1].n_lines, rows[1].n_removed, rows[2].n_removed) == (100_000, 50_000, 0)


def test_many_spans_in_one_text(spark):
    text = "some words here " * 30_000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").cache()
    docs.count()
    bench = spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    start = time.perf_counter()
    assert without_spans(docs, bench).first().text.split() == ["here"] * 30_000
    r = contamination(docs, bench).first()
    assert time.perf_counter() - start < 60 and (r.n_hit, len(r.spans)) == (60_000, 30_000)
