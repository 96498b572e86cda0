"""Lower-casing in decontamination doesn't depend on what stands beside a word."""

import pytest

from gradelake.llm.decontamination import contamination


@pytest.mark.parametrize("most", [200_000, 0])
def test_capital_sigma_beside_a_stop(spark, most):
    docs = spark.createDataFrame([(1, "ΟΔΟΣ.Α"), (2, "x ΟΔΟΣ Α y"), (3, "Α.Σ. Β"), (4, "οδος α")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "ΟΔΟΣ Α"), (2, "Α Σ Β")], "item_id bigint, text string")
    found = contamination(docs, items, most_hashes=most).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in found] == [(2, 2, ["1"]), (4, 2, ["1"]), (3, 3, ["2"]), (2, 0, [])]
