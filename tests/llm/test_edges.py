"""Rows that are odd, for the operators that learn and search: nulls, repeats, very long texts, empty tables, clashing columns."""

import zlib

import numpy as np
import pytest

from codelake.llm import contamination, lm, quality, toxicity

ODD = "doc_id long, text string, score double, n_tokens int, key string"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "some plain words stand here", 0.0, 1, "k"), (1, "some plain words stand here", 0.0, 1, "k"), (2, None, None, None, None), (3, "", 0.0, 1, "k"), (None, "no id at all", 0.0, 1, "k"), (4, long, 0.0, 1, "k"), (5, "x" * 50_000, 0.0, 1, "k"), (6, "\u4e00\u4e8c\ud7a3 \U0001f600", 0.0, 1, "k")]
    return spark.createDataFrame(rows, ODD)


def test_items_in_odd_documents(spark, odd):
    items = spark.createDataFrame([(1, "w7 w8 w9 w10 w11 w12 w13 w14", "x"), (1, "w7 w8 w9 w10 w11 w12 w13 w14", "x"), (2, None, "x"), (3, "", "x"), (4, "w1 w2", "x"), (None, "w1 w2 w3 w4 w5 w6", "x"), (7, "W20000  w20001\nw20002 w20003 w20004", "x"), (8, "some plain words stand here", "x"), (9, "not in any of the documents", "x")], "item_id long, text string, key string")
    found = sorted((r["doc_id"], r["item_id"], r["n_runs"], r["containment"]) for r in contamination.find_items(odd, items).collect())
    assert found == [(1, 8, 1, 1.0), (4, 1, 4, 1.0), (4, 7, 1, 1.0)]
    joined = sorted((r["doc_id"], r["item_id"]) for r in contamination.find_items(odd, items, most=0).collect())  # by a join instead of a broadcast
    assert joined == [f[:2] for f in found]
    assert contamination.find_items(odd, items.limit(0)).collect() == [] and contamination.find_items(odd.limit(0), items).collect() == []


def test_ties_at_the_threshold_count(spark):
    words = [f"v{i}" for i in range(14)]
    docs = spark.createDataFrame([(1, " ".join([*words[:12], "a", "b"])), (2, " ".join([*words[:11], "a", "b"]))], "doc_id long, text string")
    found = contamination.find_items(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["containment"]) for r in found] == [(1, 0.8)]


def test_lm_on_odd_rows(spark, odd):
    rows = lm.lm_scores(odd).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) and r["score"] < 0 for r in rows)
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((i, len(lm.tokens_of(t)) + 1) for i, t in texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows if r["doc_id"] is not None)


@pytest.mark.parametrize("scores, least", [(quality.quality_scores, 0.3), (toxicity.toxicity_scores, 0.5)])
def test_classifiers_on_repeats_and_clashing_labels(spark, odd, scores, least):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (1, 0, 1), (2, None, None), (3, 0, 0), (None, 1, 1), (4, 1, 0), (6, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = scores(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) for r in rows)
    ones = [r["score"] for r in rows if r["doc_id"] == 1]
    assert len(ones) == 2 and ones[0] == ones[1]
