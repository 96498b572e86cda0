"""Groups by min-wise hashing and verified pairs, against all pairs."""

import random
import re

import numpy as np

import corpus_pipeline
from gradelake.llm import jaccard
from gradelake.llm.jaccard import similar
from gradelake.llm.simhash import near_duplicates


def plain(texts):
    sets = {}
    for k, x in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), x or "").encode().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in sets}


def made(groups, copies, seed):
    rng, texts = random.Random(seed), ["", None, " ", "a b", "a b"]
    line = [f"c{i}" for i in range(30)]
    for g in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(40, 200))] + line
        for _ in range(copies):
            x = list(words)
            for _ in range(rng.randint(0, 6)):
                x[rng.randrange(len(x))] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(x))
    return dict(enumerate(texts))


def test_groups_equal_those_of_all_pairs(spark):
    for groups, copies in ((40, 5), (2, 100)):
        texts = made(groups, copies, groups)
        df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        assert {r.doc_id: r.component_id for r in similar(df).collect()} == plain(texts)


def test_many_rounds_of_hubs_and_shares(spark, monkeypatch):
    """One key holds texts of many groups, so that hubs are taken over and over before what is left is small."""
    calls = []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a: calls.append(pairs.count()) or verified(pairs, *a))
    # One key a text, made of the line that all have, and other keys by the text.
    monkeypatch.setattr(jaccard, "band_keys", lambda h, factors: np.array([7, *h[:3]], np.uint64))
    monkeypatch.setattr(jaccard, "SHARE", 3)
    texts = made(30, 5, 11)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want = plain(texts)
    for most in (0, 2_000):
        calls.clear()
        monkeypatch.setattr(jaccard, "MOST_EACH", most)
        assert {r.doc_id: r.component_id for r in similar(df).collect()} == want
        assert len(calls) >= (3 if most < 100 else 2)


def test_pipeline_stage_finds_differing_copies(spark):
    texts = {k: x for k, x in made(30, 2, 7).items() if x and len(x) > 9}
    want = plain(texts)
    assert len(set(want.values())) < len(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()} == set(want.values())


def test_pipeline_stage_finds_copies_by_fingerprints_alone(spark, monkeypatch):
    """No two texts share a min-wise key here. Near copies within three bits are found; texts alike in bits only stay."""
    monkeypatch.setattr(jaccard, "band_keys", lambda h, factors: np.array([h.sum()], np.uint64))
    rng, texts = random.Random(3), {}
    for g in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(1500)]
        texts[2 * g], texts[2 * g + 1] = " ".join(words), " ".join([*words, "end"])
    for k in (90, 91):
        texts[k] = "a b c d e f g " * 300 + " ".join(f"w{rng.randrange(5000)}" for _ in range(30))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    root = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    near = [g for g in range(6) if root[2 * g + 1] == 2 * g]
    assert near and root[91] == 90
    want = set(texts) - {2 * g + 1 for g in near}
    assert {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()} == want
