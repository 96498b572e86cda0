import math

import pytest
from pyspark.sql import functions as F

from gradelake.functions import scalars as S


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [(' "a b" ', "a b"), ("'x'", "x"), ("\"x'", "\"x'"), ('"', '"'), ("plain", "plain"), ('""', "")])
def test_unquote(spark, text, want):
    assert one(spark, S.unquote("t"), t=text) == want


@pytest.mark.parametrize("text,want", [("a\\b/../c", "a/c"), ("./a//b/.", "a/b"), ("../x", "../x"), ("a/../..", ".."), ("/a/../../b", "/b"), ("", "."), ("a/b/", "a/b/")])
def test_normalize_path(spark, text, want):
    assert one(spark, S.normalize_path("t"), t=text) == want


def test_filter_values(spark):
    assert one(spark, S.filter_values("t"), t=" a, ,b,") == ["a", "b"]
    assert one(spark, S.filter_values(F.lit(None).cast("string"))) == []
    assert one(spark, S.has_value(F.lit("  "))) is False


def test_percentage_rounds_half_up_on_the_exact_quotient(spark):
    rows = spark.range(1, 201).crossJoin(spark.range(0, 201).withColumnRenamed("id", "p")).where("p <= id").select("id", "p", S.percentage("p", "id").alias("x")).collect()
    for r in rows:
        exact = (r.p / r.id) * 100
        low = math.floor(exact * 10) / 10
        assert r.x in (f"{low:.1f}%", f"{low + 0.1:.1f}%")
        assert abs(float(r.x[:-1]) - exact) <= 0.05 + 1e-9
    assert one(spark, S.percentage(F.lit(1), F.lit(16))) == "6.3%"
    assert one(spark, S.percentage(F.lit(0), F.lit(0))) == "n/a"


def test_rollout_buckets(spark):
    df = spark.createDataFrame([("alice",), ("bob",)], "u string")
    got = df.select(S.rollout_bucket(F.lit("BetaCheckout"), "u"), S.rollout_bucket_signed(F.lit("BetaCheckout"), "u"), S.rollout_percentile(F.lit("BetaCheckout"), "u")).collect()
    assert [tuple(r) for r in got] == [(94, 78, 75.94), (15, 15, 21.15)]


def test_feature_percentage(spark):
    text = '{"conditions": {"client_filters": [{"name": "Other"}, {"name": "Vendor.Percentage", "parameters": {"Value": 25}}]}}'
    assert one(spark, S.feature_percentage("t"), t=text) == 25.0
    assert one(spark, S.feature_percentage("t"), t="{}") is None


def test_subject_and_urls(spark):
    s = "/blobServices/default/containers/c1/blobs/a%20b+c/d.txt"
    assert one(spark, S.subject_container("t"), t=s) == "c1"
    assert one(spark, S.subject_blob("t"), t=s) == "a b+c/d.txt"
    assert one(spark, S.subject_blob("t"), t="/nothing") is None
    assert one(spark, S.blob_url("t", F.lit("/x/y")), t="https://h.example/c?sig=1&b=2") == "https://h.example/x/y?sig=1&b=2"


def test_media_type(spark):
    assert one(spark, S.media_type("t"), t="dir.x/File.TXT") == "text/plain"
    with pytest.raises(Exception, match="Unsupported file type"):
        one(spark, S.media_type("t"), t="a.bin")


def test_statuses(spark):
    df = spark.createDataFrame([(408,), (404,), (200,)], "c int")
    assert [tuple(r) for r in df.select(S.retry_class("c"), S.status_message("c")).collect()] == [("transient", "other"), ("permanent", "not found"), ("other", "other")]
    assert one(spark, S.retry_delay(F.create_map(F.lit("retry-after"), F.lit("2")))) == 2000.0
    assert one(spark, S.retry_delay(F.create_map(F.lit("x"), F.lit("2")))) is None


def test_typed_field(spark):
    v = F.parse_json(F.lit('{"a": "x", "n": 1.5, "z": null}'))
    assert one(spark, S.typed_field(v, "$.a", "string", True)) == "x"
    assert one(spark, S.typed_field(v, "$.n", "number")) == 1.5
    assert one(spark, S.typed_field(v, "$.z", "number")) is None
    with pytest.raises(Exception, match="must be a string"):
        one(spark, S.typed_field(v, "$.n", "string"))
    with pytest.raises(Exception, match="must be a string"):
        one(spark, S.typed_field(v, "$.z", "string", True))


def test_small_texts(spark):
    assert one(spark, S.criterion_kind(F.lit("language/x"))) == "language"
    assert one(spark, S.criterion_kind(F.lit(None).cast("string"))) == "other"
    assert one(spark, S.markdown_cell(F.lit("a|b\r\nc"))) == "a\\|b c"
    assert one(spark, S.first_group(F.lit("x: 1\nname:  foo \n"), r"^name:\s*(\S+)\s*$")) == "foo"
    assert one(spark, S.supported_answer(F.array(F.lit(1)), F.lit(" unsupported: no"))) is False
    assert one(spark, S.context_text(F.array(F.lit("a"), F.lit("b")))) == "a\n\nb"


@pytest.mark.parametrize("text,want", [("a/b.txt", True), ("../a", False), ("a/../../b", False), ("/a", False), ("a b", False), ("a/../b", True), ("..", False)])
def test_safe_path(spark, text, want):
    assert one(spark, S.safe_path("t"), t=text) is want


def test_insert_after(spark):
    assert one(spark, S.insert_after("t", "^stimuli:$", "\n  - x"), t="a: 1\nstimuli:\n  - y") == "a: 1\nstimuli:\n  - x\n  - y"
    assert one(spark, S.insert_after("t", "^none$", "x"), t="a") == "a"
    assert one(spark, S.distinct_values("t"), t="b, a,,b") == ["b", "a"]
