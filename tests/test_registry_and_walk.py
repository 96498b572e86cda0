"""Functions by name, a walk that opens no pruned folder, shell commands, batches of partitions."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradelake.functions.scalars import shell_commands
from gradelake.operators.registry import Functions
from gradelake.sources import files
from gradelake.streaming import streams


def test_calls_by_name(spark):
    known = Functions(spark)
    known.scalar("weather_at", {"place": "string", "unit": "string"}, "string", "concat(place, ' ', IF(unit = 'c', 21, 70))", "contains(lower(place), 'sea') AND unit IN ('c', 'f')")
    known.scalar("twice_of", {"x": "bigint"}, "bigint", "2 * x")
    calls = spark.createDataFrame([(1, "weather_at", '{"place":"Seaside","unit":"c"}'), (2, "twice_of", '{"x":9007199254740993}')], "id int, name string, a string").withColumn("arguments", F.parse_json("a"))
    assert [r.result for r in known.called(calls).orderBy("id").collect()] == ["Seaside 21", "18014398509481986"]
    assert "ArrowEval" not in known.called(calls)._jdf.queryExecution().executedPlan().toString()
    assert spark.sql("SELECT twice_of(4) AS x").first().x == 8
    for name, text, said in (("other", "{}", "Unknown function: other"), (None, "{}", "Unknown function: "), ("weather_at", '{"place":"Rome","unit":"c"}', "Invalid arguments for weather_at"), ("weather_at", '{"place":"Seaside"}', "Invalid"), ("twice_of", '{"x":1,"y":2}', "Invalid"), ("twice_of", '{"x":"a"}', "Invalid"), ("twice_of", "5", "Invalid")):
        bad = spark.createDataFrame([(name, text)], "name string, a string").select("name", F.parse_json("a").alias("arguments"))
        with pytest.raises(Exception, match=said):
            known.called(bad).collect()
    for name in ("twice_of", "a b", "x;y"):
        with pytest.raises(ValueError):
            known.scalar(name, {"x": "bigint"}, "bigint", "x")


def test_functions_that_give_rows(spark):
    known = Functions(spark)
    known.table("up_to", {"n": "int"}, "k bigint", "SELECT id AS k FROM range(10) WHERE id < n")
    assert [r.k for r in spark.sql("SELECT k FROM up_to(3) ORDER BY k").collect()] == [0, 1, 2]

    class Doubled:
        def eval(self, table: pa.RecordBatch):
            yield pa.table({"y": pa.array([2 * v for v in table.column(0).to_pylist()], pa.int64())})

    known.python_table("doubled", Doubled, "y bigint")
    spark.range(5).withColumnRenamed("id", "x").createOrReplaceTempView("five")
    assert sorted(r.y for r in spark.sql("SELECT y FROM doubled(TABLE(five))").collect()) == [0, 2, 4, 6, 8]


def test_a_walk_opens_no_pruned_folder(spark, tmp_path):
    for x in ("a.py", "src/b.py", "src/deep/er/c.py", "node_modules/x/y.py", "src/node_modules/z.py", "skill/SKILL.md", "skill/d.py", "skill/in/e.py", "src/node_modules.py", "SKILL.md", "empty/.keep"):
        (tmp_path / x).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / x).write_text("")
    found, listed = files.walked(spark, f"file://{tmp_path}", ["node_modules", ".git"], "SKILL.md")
    assert sorted(r.path for r in found.collect()) == ["SKILL.md", "a.py", "empty/.keep", "src/b.py", "src/deep/er/c.py", "src/node_modules.py"]
    assert sorted(r.path for r in listed.collect()) == ["", "empty", "skill", "src", "src/deep", "src/deep/er"]


def test_shell_commands(spark):
    text = "a:\n    command: npm\n    args:\n      - install\nb:\n  command: npx\r\n  args:\r\n    - tsc\nc:\n  command: npm\n  other: 1\n  command: node\n  args:\n"
    df = spark.createDataFrame([(p, text) for p in ("win32", "linux")], "p string, t string")
    got = {r.p: r.x for r in df.select("p", shell_commands("t", "p").alias("x")).collect()}
    assert got["linux"] == text
    assert got["win32"] == "a:\n    command: cmd.exe\n    args:\n      - /d\n      - /s\n      - /c\n      - npm\n      - install\nb:\n  command: cmd.exe\n  args:\n    - /d\n    - /s\n    - /c\n    - npx\n    - tsc\nc:\n  command: npm\n  other: 1\n  command: node\n  args:\n"


def test_batches_of_partitions(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 3).alias("part")).write.parquet(f"{tmp_path}/in")
    got = []
    streams.event_batches(streams.read_events(spark, f"{tmp_path}/in", "id bigint, part bigint"), lambda rows, n: got.extend(rows.groupBy("part", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()), f"{tmp_path}/cp", 100, "id", "part")
    assert {(r.part, r.batch, r.n, r.lo) for r in got} == {(p, b, 100 if b < 3 else 334 - 300 if p == 0 else 33, p + 300 * b) for p in range(3) for b in range(4)}
