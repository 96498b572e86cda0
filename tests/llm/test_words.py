"""Words of decontamination: the same for any text, made with little garbage."""

import re

import pytest
from pyspark.sql import functions as F

from gradelake.llm.decontamination import contamination, words

ODD = ["", "A", "Aa ZZ-z[Y]{X}@W`V", "Straße ÉCOLE École İI ıI KELVIN K", "ΟΔΟΣ.Α Σ", "x\x00Y\x7fZ\x80Q", "naïve—DASH “Quoted” Text", "日本 ABC語DEF", "🙂A🙂 B", "9A9 \n\t_Q_", "É", "—"]


def test_words_of_any_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "k int, text string")
    got = {r.k: r.w for r in df.select("k", F.expr(words("text")).alias("w")).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for i, t in enumerate([*ODD, None])}
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = rf"array_remove(split(translate(text, '{upper}', '{lower}'), r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+', -1), '')"
    broken = spark.sql("SELECT explode(array(X'41FF42', X'41C1', X'80C34142', X'E2804142', X'4142F5')) AS b").select(F.expr("cast(b as string)").alias("text"))
    r = broken.select(F.expr(f"{words('text')} = {plain}").alias("same")).collect()
    assert len(r) == 5 and all(x.same for x in r)


def _allocated(spark, df) -> int:
    jvm = spark._jvm
    bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.ThreadMXBean"))
    now = lambda: sum(x for x in bean.getThreadAllocatedBytes(bean.getAllThreadIds()) if x > 0)
    before = now()
    df.write.format("noop").mode("overwrite").save()
    return now() - before


@pytest.mark.parametrize("end, most", [("", 60), ("é", 81)])
def test_little_garbage_for_each_character(spark, end, most):
    text = "Some Words of a longer text, as they stand in most of them; " * 300 + end
    df = spark.range(0, 300, 1, 4).select(F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).localCheckpoint()
    split = df.select(F.expr(f"size({words('text')})").alias("n"))
    used = min(_allocated(spark, split) for _ in range(4)) / (300 * len(text))
    assert used < most


def test_many_words_in_one_text(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("concat(repeat('Some other word ', 100000), 'a b c')").alias("text"))
    items = spark.createDataFrame([(1, "a b c"), (2, "x y z " * 5)], "item_id bigint, text string")
    r = contamination(docs, items).first()
    assert (r.n_words, r.n_hit, r["items"]) == (300_003, 3, ["1"])
