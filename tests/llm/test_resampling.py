"""Resampling against plain Python, whole texts in pieces, edges."""

import collections
import hashlib
import math
import re
import zlib

import pytest

from gradelake.llm import resampling
from gradelake.llm.resampling import bucket_counts, counted, database, pieces, resampled
from gradelake.llm.shared import staged


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def buckets(text):
    w = words(text)
    return collections.Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, target):
    s, t = collections.Counter(), collections.Counter()
    for _, x in docs:
        s.update(buckets(x))
    for _, x in target:
        t.update(buckets(x))
    a, b = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b))) for k in s}
    out = []
    for i, x in docs:
        c = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain[k] for k, n in c.items())
        out.append((i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20))
    able = sorted((k for k, r in enumerate(out) if r[4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    rank = {k: n for n, k in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(out)), key=repr)


def frame(spark, rows, key="doc_id"):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], f"{key} bigint, text string, score string, whole string, `b.c` string")


TARGET = [(1, "the quick brown fox jumps"), (None, "over the lazy dog"), (2, None), (3, "")]


def test_against_plain_python(spark):
    texts = [" ".join(f"{w} {'the quick brown fox' if i % 7 == 0 else 'é Straße漢'} {i % 5}" for w in ("Alpha", "beta-x", "GAMMA", "d\x00e", "ü") for _ in range(1 + i % 4)) for i in range(300)]
    docs = [(i, x) for i, x in enumerate(texts)] + [(None, texts[0]), (None, texts[7]), (7, texts[7]), (7, texts[7]), (900, None), (901, ""), (902, " .,\n"), (903, "one"), (904, "one two"), (905, "word " * 200_000), (906, "x" * 100_000)]
    got = resampled(frame(spark, docs), frame(spark, TARGET, "item_id"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, TARGET)


def test_ranks_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE", 10)
    docs = [(i // 2, "same words here " * 10) for i in range(500)]  # equal weights, repeated ids
    got = sorted(map(tuple, resampled(frame(spark, docs), frame(spark, TARGET, "item_id")).collect()), key=repr)
    assert got == plain(docs, TARGET)


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "a few words")]])
def test_small_tables(spark, docs):
    got = sorted(map(tuple, resampled(frame(spark, docs), frame(spark, [], "item_id")).collect()), key=repr)
    assert got == plain(docs, [])


@pytest.mark.parametrize("size", [1, 3, 10, 1 << 20])
def test_pieces_lose_no_run(size):
    con = database()
    texts = ["One two, three FOUR five-six seven.", None, "", "   ", "a", "a b", "...a    b    ....    c d e f", "é漢 ß x", "long" * 50 + " tail " + "." * 100 + " end"]
    n, found, counts = bucket_counts(con, texts, size)
    assert n.tolist() == [len(words(x)) for x in texts]
    assert [dict(zip(b.tolist(), c.tolist())) for b, c in zip(found, counts)] == [dict(buckets(x)) for x in texts]
    assert sum(len(words(p)) for p, _ in pieces(texts[0], size)) == 7


def test_many_pieces_are_summed(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(3000))
    _, found, counts = bucket_counts(database(), [text], 20)
    assert dict(zip(found[0].tolist(), counts[0].tolist())) == dict(buckets(text))


def test_no_python_in_tasks(spark, monkeypatch):
    """Beside Python workers and the batches sent to them, an executor's memory passed its limit."""
    plans = []
    monkeypatch.setattr(resampling, "staged", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    out = resampled(frame(spark, [(i, "some words here " * 9) for i in range(50)]), frame(spark, TARGET, "item_id"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 5 and not any(re.search("InArrow|InPandas|Python", p) for p in plans)


@pytest.mark.parametrize("size", [1, 3, 10, 1 << 20])
def test_pieces_cut_by_spark_lose_no_run(spark, size):
    texts = ["One two, three FOUR five-six seven.", None, "", "   ", "a", "a b", "...a    b    ....    c d e f", "é漢 ß x", "long" * 50 + " tail " + "." * 100 + " end", "a\U0001f600 b\n\U0001f600 " * 30]
    got = counted(frame(spark, list(enumerate(texts))), "doc_id", "text", "counts", size).collect()
    for i, x in enumerate(texts):
        mine = [r for r in got if r.doc_id == i]
        assert len({r.row for r in mine}) == 1 and sum(r.b1 is not None for r in mine) == len(words(x))
        assert collections.Counter(b for r in mine for b in (r.b1, r.b2, r.b3) if b is not None) == buckets(x)


def test_long_texts(spark):
    texts = ["a\U0001f600" * 300_000 + " b c", "\U0001f600 x " * 200_000, "y. " * 300_000, " " * 600_000 + "z", "." * 600_000]
    docs = list(enumerate(texts))
    assert sorted(map(tuple, resampled(frame(spark, docs), frame(spark, TARGET, "item_id")).collect()), key=repr) == plain(docs, TARGET)
