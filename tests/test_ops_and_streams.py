import json

import pytest
from pyspark.sql import functions as F

from gradelake.operators import ops, scans
from gradelake.sources import files
from gradelake.streaming import streams


def test_pages_cover_all_rows_once(spark):
    df = spark.range(0, 230, 3).withColumnRenamed("id", "k")
    seen, token = [], None
    while rows := [r.k for r in ops.keyset_page(df, "k", 50, token).collect()]:
        seen, token = seen + rows, rows[-1]
    assert seen == list(range(0, 230, 3))


def test_chunks(spark):
    rows = ops.chunks(spark.range(1000).repartition(7), "id", 256).collect()
    assert all(r.chunk == r.id // 256 for r in rows)
    named = ops.global_rank(spark.createDataFrame([("b",), ("a",)], "k string"), "k").collect()
    assert {(r.k, r["rank"]) for r in named} == {("a", 0), ("b", 1)}
    keys = sorted(f"k{i * 7919 % 20011}" for i in range(20_000))
    ranked = ops.global_rank(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()
    assert {r.k: r["rank"] for r in ranked} == {k: i for i, k in enumerate(keys)}


def test_batches(spark):
    df = spark.createDataFrame([("a", 1, 60), ("a", 2, 40), ("a", 3, 1), ("b", 1, 100), ("b", 2, 100)], "k string, n int, size int")
    got = {(r.k, r.n): r.batch for r in scans.bounded_batches(df, ["k"], ["n"], "size", 100).collect()}
    assert got == {("a", 1): 0, ("a", 2): 0, ("a", 3): 1, ("b", 1): 0, ("b", 2): 1}
    with pytest.raises(Exception, match="exceeds the batch limit"):
        scans.bounded_batches(df, ["k"], ["n"], "size", 99).collect()


def test_first_and_last(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("y", 2, "b"), ("x", 3, None)], "k string, n int, v string")
    assert {tuple(r) for r in ops.first_by(df, ["k"], F.col("n")).collect()} == {("x", 1, "a"), ("y", 2, "b")}
    assert {tuple(r) for r in ops.last_by(df, ["k"], F.col("n")).collect()} == {("x", 3, None, 1), ("y", 2, "b", 2)}


def test_streaks(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, None, True, True, True, True, False])], "k int, i int, f boolean")
    rows = ops.consecutive_failures(df, ["k"], "i", F.col("f")).orderBy("i").collect()
    assert [r.streak for r in rows] == [1, 2, 0, 1, 2, 3, 4, 0] and [r.open for r in rows] == [False] * 5 + [True, True, False]


def test_settings(spark):
    old = spark.createDataFrame([("a", None, "1"), ("b", None, "1"), ("c", None, None)], "key string, label string, etag string").fillna("", ["label"])
    new = spark.createDataFrame([("a", "", "1"), ("b", "", "2"), ("c", "", None), ("d", "", None)], "key string, label string, etag string")
    assert sorted(r.key for r in ops.changed_settings(old, new, ["key", "label"], ["etag"]).collect()) == ["b", "d"]
    assert ops.any_changed(old, new, ["key", "label"], ["etag"]).first().changed is True


def test_dispatch(spark):
    allowed = {"weather": lambda x: x.isin("rome", "oslo")}
    df = spark.createDataFrame([("weather", "rome")], "f string, a string")
    assert df.select(ops.dispatch_checked("f", F.col("a"), allowed)).first()[0] == "rome"
    for bad in (("weather", "nowhere"), ("drop", "rome")):
        with pytest.raises(Exception, match="Unknown function|Invalid arguments"):
            spark.createDataFrame([bad], "f string, a string").select(ops.dispatch_checked("f", F.col("a"), allowed)).collect()


def test_citations(spark):
    body = {"output": [{"type": "file_search_call", "results": [{"file_id": "f1", "text": "t"}]}, {"type": "message", "content": [{"type": "output_text", "text": "hi", "annotations": [{"type": "file_citation", "file_id": "f1"}, {"type": "x"}]}, {"type": "refusal"}]}, {"type": "message"}]}
    df = spark.createDataFrame([(1, json.dumps(body))], "id int, j string").select("id", F.parse_json("j").alias("body"))
    rows = [(r.kind, r.file_id, r.text) for r in ops.citations(df).orderBy("id", "pos").collect()]
    assert rows == [("result", "f1", "t"), ("text", None, "hi"), ("citation", "f1", None)]


def test_versions_and_more(spark):
    now = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, version int, v string")
    new = spark.createDataFrame([("a", 1, "x2"), ("b", 1, "y2"), ("c", None, "z")], "k string, version int, v string")
    assert {tuple(r) for r in ops.upsert_versions(now, new, "k").collect()} == {("a", 2, "x2", False), ("b", 2, "y", True), ("c", 1, "z", False)}
    df = spark.createDataFrame([("The cat sat", "the cat"), ("x", "y")], "r string, t string")
    assert [round(r[0], 3) for r in df.select(ops.token_f1(F.col("r"), F.col("t"))).collect()] == [0.8, 0.0]
    assert [r.x for r in ops.locale_sorted(spark.createDataFrame([("b",), ("B",), ("a",), ("Á",)], "x string"), "x").collect()] == ["a", "Á", "b", "B"]


def test_eval_cases(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('\n{"id":"1","query":"q","groundTruth":"g"}\n\n{"id":"2","query":"q","groundTruth":"g"}')
    assert [(r.line, r.id) for r in files.eval_cases(spark, str(good)).orderBy("line").collect()] == [(2, "1"), (4, "2")]
    bad = tmp_path / "b.jsonl"
    bad.write_text('\n\n{"id":"1"}')
    with pytest.raises(Exception, match="line 3"):
        files.eval_cases(spark, str(bad)).collect()
    (tmp_path / "c.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        files.eval_cases(spark, str(tmp_path / "c.jsonl"))


def test_pruned_walk(spark):
    paths = ["r/a.py", "r/node_modules/b.py", "r/skill/SKILL.md", "r/skill/deep/c.py", "r/x/d.py", "r/venv.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.path for r in files.pruned(df, ["node_modules", "venv"], "SKILL.md").collect()) == ["r/a.py", "r/venv.py", "r/x/d.py"]


EVENTS = "event_id bigint, kind string, value double"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(i, ["a", "b", "z"][i % 3], float(i)) for i in range(30)], EVENTS).repartition(5).write.parquet(str(tmp_path / "in"))
    return tmp_path


def test_checkpointed_ingest(spark, folder):
    for _ in range(2):
        streams.ingest(streams.read_events(spark, f"{folder}/in", EVENTS, 2), f"{folder}/out", f"{folder}/cp", 60)
    assert spark.read.parquet(f"{folder}/out").count() == 30
    spark.createDataFrame([(99, "a", 1.0)], EVENTS).write.mode("append").parquet(f"{folder}/in")
    streams.ingest(streams.read_events(spark, f"{folder}/in", EVENTS), f"{folder}/out", f"{folder}/cp")
    assert spark.read.parquet(f"{folder}/out").count() == 31


def test_routes(spark, folder):
    streams.by_type(streams.read_events(spark, f"{folder}/in", EVENTS), {"a": f"{folder}/a", "b": f"{folder}/b", None: f"{folder}/rest"}, "kind", f"{folder}/cp")
    assert [spark.read.parquet(f"{folder}/{x}").count() for x in ("a", "b", "rest")] == [10, 10, 10]
    streams.fan_out(spark, f"{folder}/in", EVENTS, {"large": F.col("value") > 20, "all": F.lit(True)}, f"{folder}/subs", f"{folder}/cps")
    assert [spark.read.parquet(f"{folder}/subs/{x}").count() for x in ("large", "all")] == [9, 30]


def test_settlement_and_schedules(spark, folder):
    streams.route_settled(streams.read_events(spark, f"{folder}/in", EVENTS), F.col("value") >= 3, F.col("kind") == "z", f"{folder}/s", f"{folder}/cp2")
    counts = {r.settlement: r["count"] for r in spark.read.parquet(f"{folder}/s").groupBy("settlement").count().collect()}
    assert counts == {"abandon": 10, "complete": 18, "dead-letter": 2}
    dead = spark.read.parquet(f"{folder}/s").where("settlement = 'dead-letter'")
    assert {r.settlement for r in streams.retried(dead, F.col("value") >= 0, 10, "event_id").collect()} == {"complete"}
    now = F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame([(1, 429, 1), (2, 429, 3), (3, 500, 1)], "id int, code int, attempt int")
    assert [r.next_attempt for r in streams.retry_schedule(rows, "code", "attempt", F.lit(1500), now).orderBy("id").collect()] == [2, None, None]
    due = spark.createDataFrame([(1, None, None), (2, "2023-12-31", False), (3, "2024-02-01", None), (4, "2023-01-01", True)], "id int, at string, off boolean").withColumn("at", F.col("at").cast("timestamp"))
    assert sorted(r.id for r in streams.scheduled(due, "at", now, "off").collect()) == [1, 2]


def test_flattened(spark):
    df = spark.createDataFrame([('[{"id":"1","eventType":"A","subject":"s"},{"id":"2","type":"B"}]',)], "payload string")
    assert [tuple(r) for r in streams.flattened(df).collect()] == [("1", "A", "s"), ("2", "B", None)]


def test_sessions_are_in_order_over_batches(spark, folder):
    streams.session_sequences(streams.read_events(spark, f"{folder}/in", EVENTS, 1), "kind", "event_id", f"{folder}/q", f"{folder}/cp3")
    rows = spark.read.parquet(f"{folder}/q/rows")
    assert rows.count() == 30 and {tuple(r) for r in rows.groupBy("kind").agg(F.countDistinct("sequence"), F.max("sequence")).collect()} == {("a", 10, 10), ("b", 10, 10), ("z", 10, 10)}


def test_small_sources_and_settings(spark):
    df = spark.createDataFrame([("r/x/a",), ("r/y",)], "path string")
    assert [r.name for r in files.under(df, "r/x/").collect()] == ["a"]
    assert files.json_lines('{"a":1}\r\n\n2') == [{"a": 1}, 2]
    for bad in ("{", "NaN", None):
        with pytest.raises(ValueError):
            files.json_lines(bad)
    old = spark.createDataFrame([("s", "1"), ("a", "x")], "key string, etag string")
    new = spark.createDataFrame([("s", "1"), ("a", "y")], "key string, etag string")
    assert ops.refreshed(old, new, F.col("key") == "s", ["key"], ["etag"]).where("key = 'a'").first().etag == "x"
    moved = new.replace("1", "2")
    assert ops.refreshed(old, moved, F.col("key") == "s", ["key"], ["etag"]).where("key = 'a'").first().etag == "y"
    assert ops.of_kind(old, "key", "a").count() == 1


def test_sessions_keep_every_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "WHOLE_EVERY", 2)
    kind = "id bigint, big bigint, price decimal(38,10), tags array<struct<a:bigint,b:string>>, k string, seen bigint"
    rows = [(i, None if i % 2 else 2**53 + 1 + i, None if i % 3 else f"{i}.0000000001", [(2**60 + i, None)] if i % 4 else None, None if i % 5 == 0 else "k", 7) for i in range(60)]
    df = spark.createDataFrame([(r[0], r[1], r[3], r[4], r[5], r[2]) for r in rows], "id bigint, big bigint, tags array<struct<a:bigint,b:string>>, k string, seen bigint, p string").selectExpr("id", "big", "cast(p as decimal(38,10)) price", "tags", "k", "seen")
    for n in range(6):
        df.where(f"id div 10 = {n}").write.mode("append").parquet(f"{tmp_path}/in")
        streams.session_sequences(streams.read_events(spark, f"{tmp_path}/in", kind), "k", "id", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out/rows").drop("micro_batch")
    assert sorted(map(repr, got.drop("sequence").collect())) == sorted(map(repr, df.collect()))
    for key in (None, "k"):
        assert [r.sequence for r in got.where(F.col("k").eqNullSafe(F.lit(key))).orderBy("id").collect()] == list(range(1, 1 + sum(r[4] == key for r in rows)))


def test_timers_give_out_messages_once(spark, tmp_path):
    import datetime
    import time

    now = datetime.datetime.fromtimestamp(int(time.time()))
    kind = "id bigint, at timestamp, off boolean, note string"

    def send(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    run = lambda s: streams.delivered(streams.read_events(spark, f"{tmp_path}/in", kind), "id", "at", f"{tmp_path}/out", f"{tmp_path}/cp", s, "off")
    seen = lambda: sorted(r.id for r in spark.read.schema(kind).parquet(f"{tmp_path}/out").collect())
    later = now + datetime.timedelta(seconds=45)
    send((1, None, None, "no time"), (2, now - datetime.timedelta(days=1), False, "past"), (3, later, False, "waits"), (4, later, False, "taken back"), (2**53 + 1, later, None, None))
    run(15)
    assert seen() == [1, 2]
    send((4, None, True, None))
    run(max(5, 50 - (datetime.datetime.now() - now).total_seconds()))
    assert seen() == [1, 2, 3, 2**53 + 1]
    run(5)
    assert seen() == [1, 2, 3, 2**53 + 1]


def test_settings_are_read_again_when_the_sentinel_moves(spark, tmp_path):
    for i in range(4):
        spark.createDataFrame([(i, "a")], "id int, key string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    versions = iter([("1", "x"), ("1", "y"), ("2", "y"), ("2", "z")])

    def settings():
        sentinel, value = next(versions)
        return spark.createDataFrame([("sentinel", sentinel), ("a", value)], "key string, value string")

    streams.with_settings(streams.read_events(spark, f"{tmp_path}/in", "id int, key string", 1), settings, F.col("key") == "sentinel", ["key"], ["value"], f"{tmp_path}/out", f"{tmp_path}/cp")
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("micro_batch").collect()
    assert [r.value for r in rows] == ["x", "x", "y", "y"]


def test_a_limit_of_retries_has_an_order(spark):
    dead = spark.createDataFrame([(i, float(i)) for i in range(30)], "id int, value double")
    rows = streams.retried(dead, F.col("value") > 5, 10, "id").collect()
    assert len(rows) == 30 and {r.id for r in rows if r.settlement == "complete"} == {6, 7, 8, 9}
    with pytest.raises(ValueError):
        streams.retried(dead, F.lit(True))
