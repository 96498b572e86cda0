"""The pipeline against a plain version of its stages."""

import collections
import re
import zlib

import numpy as np

from pyspark.sql import functions as F

import corpus_pipeline
from gradelake.llm.packing import encoder, public_vocabulary
from gradelake.llm.quality_rules import STOP_WORDS
from test_jaccard import plain as five_word_groups
from test_operators import plain_contamination

SF = "/root/testdata/sf0.001"
WORD = "[^\x20\x09-\x0d]"


def kept_by_quality(x):
    w = re.findall(WORD + "+", x)
    lines = [y for y in x.split("\n") if re.search(WORD, y)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    n = len(w)
    return n >= 50 and len(cover) <= n / 2 and 2 * n <= sum(map(len, w)) <= 20 * n and sum(c in "#*$%&|<>" for c in x) <= 0.3 * n and x.count("!") <= 0.3 * n and sum(y in set(STOP_WORDS) for y in w) >= 0.04 * n and len(lines) - len(set(lines)) <= 0.5 * len(lines)


def lines_deduped(texts):
    seen, gone = set(), collections.defaultdict(set)
    for k in sorted(texts):
        lines = texts[k].split("\n")
        filled = [i for i, y in enumerate(lines) if re.search(WORD, y)]
        for j in range(len(filled) - 2):
            key = tuple(lines[i] for i in filled[j : j + 3])
            if key in seen:
                gone[k] |= set(filled[j : j + 3])
            seen.add(key)
    out = {}
    for k, x in texts.items():
        lines = [y for i, y in enumerate(x.split("\n")) if i not in gone[k]]
        if not gone[k] or any(re.search(WORD, y) for y in lines):
            out[k] = "\n".join(lines)
    return out


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    quality = {k: x for k, x in texts.items() if kept_by_quality(x)}
    lines = lines_deduped(quality)
    unique = {k: lines[k] for k in set(five_word_groups(lines).values())}
    judged = plain_contamination(unique, items)
    clean = {k: x for k, x in unique.items() if not judged[k][3]}

    now = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], (quality, lines, unique, clean)):
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns
        rows = now.collect()
        assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)

    encode = encoder(open(public_vocabulary(), "rb").read())
    pieces = set()
    for k, x in clean.items():
        ids = np.array([*encode(x), 2], dtype="<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        pieces |= {(k, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == pieces and len(rows) == len(pieces)
    places = collections.defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 1024


def test_repeated_rows_leave_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    twice = docs.unionByName(docs)
    out = corpus_pipeline.one_of_each(spark, twice, SF)
    assert out.count() == corpus_pipeline.one_of_each(spark, docs, SF).count()


def test_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    clashing = ["quality", "_quality", "row", "t", "a.b", "gone", "removed", "_t", "digest", "_digest", "_lines", "id", "h", "emptied"]
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(clashing)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, more = stage(spark, docs, SF), stage(spark, wide, SF)
        assert more.columns == wide.columns
        rows = more.collect()
        assert {r.doc_id: r.text for r in rows} == {r.doc_id: r.text for r in plain.collect()}
        assert {tuple(r)[-len(clashing) :] for r in rows} == {tuple(range(len(clashing)))}


def test_nulls_and_no_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (None, "", None, None, 0), (2, None, "en", None, None), (2, None, "en", None, None)]
    for given in (rows, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, spark.createDataFrame(given, schema), SF).collect()
            want = {"quality rules": 0, "line dedup": 4, "near-dedup by min-wise hashing": 1, "benchmark decontamination": 4, "best-fit packing": 4}[name]
            assert len(out) == (want if given else 0), name
