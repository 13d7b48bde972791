"""The text operators against brute force, and on odd inputs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import contamination, embeddings, lm, neardup, quality, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts, 1)], DOCS)


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates_equal_brute_force(documents):
    texts = {r["doc_id"]: runs(r["text"]) for r in documents.collect()}
    group = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and texts[a] and texts[b] and len(texts[a] & texts[b]) >= 0.8 * len(texts[a] | texts[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents).collect()}
    assert found == group


def test_near_duplicates_join_families_at_the_threshold(spark):
    rng, texts = np.random.default_rng(5), []
    for i in range(120):
        words = [f"w{j}" for j in range(2040)]
        for p in rng.choice(406, 25, replace=False):  # 125 of 2036 runs: most pairs are a little below 0.8
            words[5 * p + 4] = f"d{i}_{p}"
        texts.append(" ".join(words))
    sets = [runs(t) for t in texts]
    group = list(range(1, len(texts) + 1))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, *texts)).collect()}
    assert [found[i] for i in range(1, len(texts) + 1)] == group


def test_near_duplicates_on_odd_rows(spark, nothing):
    found = neardup.near_duplicates(docs_of(spark, None, "", "one two", "ONE  two", "one three")).orderBy("doc_id").collect()
    assert [(r["class_id"], r["kept"]) for r in found] == [(1, True), (2, True), (3, True), (3, False), (5, True)]
    assert neardup.near_duplicates(nothing).count() == 0


def weighted_runs(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def test_weighted_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(12):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
        for times in (1, 1, 2, 3, 8):  # as sets of runs these are alike, by counts not all of them
            texts.append(" ".join(base + base[:30] * times))
    n = [weighted_runs(t) for t in texts]
    group = list(range(1, len(texts) + 1))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and (n[a] & n[b]).total() >= 0.8 * (n[a] | n[b]).total():
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(docs_of(spark, *texts), weights="count", least_share=0.0).collect()}
    assert [found[i] for i in range(1, len(texts) + 1)] == group


def test_near_duplicates_of_odd_rows_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, 1, "k"), (2, long + " end", 2, "k"), (2, long + " end", 2, "k"), (3, "a b c d e f", 3, "k"), (None, "a b c d e f", 4, "k"), (None, None, 5, "k")]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, class_id int, band string")).collect()
    want = [("1", "1", True), ("2", "1", False), ("2", "1", False), ("3", "3", True), ("None", "None", True), ("None", "None", True)]
    assert sorted((str(r["doc_id"]), str(r["class_id"]), r["kept"]) for r in found) == want


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.03, base[:1] + rng.normal(size=(30, 16)) * 0.02]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, x[0].tolist(), None), (1004, [None] * 16, 0), (1005, [], 0)]
    found = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    least = np.arange(len(x))
    for _ in range(len(x)):
        least = np.array([least[row].min() for row in linked])
    for i in range(len(x)):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (linked[i].sum() - 1, least[i], least[i] == i)
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(1000, 1006))


def links_by_hand(rows):
    """{vec_id: (n_links, least vec_id reachable)} over usable (vec_id, vector, label) rows."""
    ids = [r[0] for r in rows]
    linked = np.zeros((len(rows), len(rows)), bool)
    for a, (_, v, k) in enumerate(rows):
        for b in range(a):
            if k == rows[b][2] and len(v) == len(rows[b][1]):
                x, y = np.array(v, float), np.array(rows[b][1], float)
                linked[a, b] = linked[b, a] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98
    least = np.array(ids)
    for _ in ids:
        new = np.minimum(least, [least[row].min() if row.any() else 1 << 60 for row in linked])
        if (new == least).all():
            break
        least = new
    return {i: (int(row.sum()), int(c)) for i, row, c in zip(ids, linked, least)}


@pytest.mark.parametrize("d", [1, 2, 16, 64, 384, 768])
def test_vector_links_at_any_dimension(spark, d):
    rng = np.random.default_rng(d)
    rows = []
    for i in range(240):
        v = rng.normal(size=d) if i % 4 == 0 else np.array(rows[i - i % 4][1]) + rng.normal(size=d) * 0.05 * (i % 4)
        rows.append((i, v.tolist(), 1))
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    expected = links_by_hand(rows)
    if d == 2:  # thousands of pairs at the very border, of which one in a thousand may be missed
        assert all(found[i][0] <= n for i, (n, _) in expected.items()) and sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in expected.values())
    else:
        assert found == expected


def test_equal_vectors_are_counted_not_compared(spark):
    rng = np.random.default_rng(9)
    v, w = rng.normal(size=(2, 64))
    rows = [(i, v.tolist(), 1) for i in range(5000)] + [(5000, (v * 3 + 0.001).tolist(), 1), (5001, w.tolist(), 1), (7, v.tolist(), 1), (5002, [1.0, 2.0], 1), (5003, [2.0, 4.0], 1), (None, v.tolist(), 1)]
    rows = [(*r, "x") for r in rows]
    found = [tuple(r) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, digest string")).collect()]
    assert len(found) == len(rows) and found.count((7, 5000, 0, False)) == 2
    by_id = {r[0]: r[1:] for r in found}
    assert all(by_id[i] == (5000, 0, i == 0) for i in range(5001)) and by_id[5001] == (0, 5001, True)
    assert by_id[5002] == (1, 5002, True) and by_id[5003] == (1, 5002, False) and by_id[None] == (0, None, True)


def test_hot_buckets_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "TOGETHER", 32)
    rng = np.random.default_rng(10)
    v = rng.normal(size=32)
    rows = [(i, (v + rng.normal(size=32) * 0.1 * (i % 3)).tolist(), 1) for i in range(150)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == links_by_hand(rows)


def test_no_vectors_no_links(spark):
    assert embeddings.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_lm_base_score_and_gain(spark, documents, nothing):
    found = {r["doc_id"]: r for r in lm.lm_scores(documents).collect()}
    texts = {r["doc_id"]: lm.tokens_of(r["text"] or "") + [lm.END] for r in documents.collect()}
    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in learn for w in texts[i])
    n, v = sum(c.values()), len(c)
    for i, words in texts.items():
        base = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        r = found[i]
        assert r["base_score"] == pytest.approx(base) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), n)
        assert r["held_out"] == (i not in learn)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.lm_scores(nothing).count() == 0


def test_lm_probabilities_add_up_to_one(spark):
    model = lm.Bilinear(np.random.default_rng(4).normal(0, 0.3, (lm.CLASSES + 2 * lm.DIMENSIONS, lm.DIMENSIONS + 1)))
    one, two = model.products()
    logs = lm.normalisers(spark, model)
    for a, b in ((0, 1), (5, 1000), (700, 700)):
        assert np.exp(one[a].astype(float) + two[b] - logs[a, b]).sum() == pytest.approx(1, abs=1e-5)


def test_items_in_documents_equal_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    own = {r["item_id"]: runs(r["text"]) for r in items.collect() if len((r["text"] or "").split()) >= 5}
    want = {(r["doc_id"], i) for r in documents.collect() for i, x in own.items() if len(x & runs(r["text"])) >= 0.8 * len(x)}
    assert {(r["doc_id"], r["item_id"]) for r in contamination.find_items(documents, items).collect()} == want
    assert {(r["doc_id"], r["item_id"]) for r in contamination.find_items(documents, items, most=0).collect()} == want


def test_items_of_one_to_four_runs_are_found(spark):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(10**6, size=n))
    items = [(i, words(5 + i % 4)) for i in range(800)]
    docs = docs_of(spark, *(f"{words(20 + i % 9)} {text} {words(30)}" for i, text in items))
    found = contamination.find_items(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(i + 1, i) for i, _ in items}


@pytest.mark.parametrize("scores, column", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifiers_on_held_out_rows(spark, scores, column):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r[column] for r in rows) >= 0.95 * len(rows)


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_on_odd_rows(spark, labels, nothing, scores):
    rows = scores(docs_of(spark, None, "", "a " * 50_000, "x"), labels).collect()
    assert len(rows) == 4 and all(0 <= r["score"] <= 1 for r in rows)
    assert scores(nothing, labels).count() == 0
    assert scores(docs_of(spark, "a b"), labels.limit(0)).count() == 1


@pytest.mark.parametrize("text", ["Shut up!", "They hate him", "Get lost!", "Go away and die!", "You make me sick", "Nobody likes you", "He is a fool", "kill them"])
def test_each_phrase_of_the_patterns_fires_its_voter(text):
    hits = toxicity.Hits([]).look(text)[0]
    assert hits[4] + hits[5] >= 1


def test_pipeline_returns_packed_pieces(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(found.columns) and found.count() > 0
