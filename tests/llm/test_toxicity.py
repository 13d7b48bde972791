"""Weak supervision: wrong labels, unlabelled rows, and the classifier against its label model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelake.llm import toxicity
from codelake.llm.common import held_out, id_and_text

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{t}.parquet").cache() for t in ("documents", "labels")]


def accuracy(scores, labels):
    rows = scores.join(labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").select("score", "toxic").collect()
    return np.mean([(r["score"] >= 0.5) == r["toxic"] for r in rows])


def test_wrong_labels_cost_little_and_the_classifier_beats_its_label_model(spark, tables):
    docs, labels = tables
    clean = accuracy(toxicity.toxicity_scores(docs, labels), labels)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.concat(F.lit("flip"), F.col("doc_id").cast("string")).cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    wrong = flipped.join(labels.select("doc_id", F.col("toxic").alias("true")), "doc_id").agg(F.avg((F.col("toxic") != F.col("true")).cast("int"))).first()[0]
    assert 0.15 < wrong < 0.25
    noisy = accuracy(toxicity.toxicity_scores(docs, flipped), labels)
    assert clean > 0.98 and noisy > clean - 0.02
    # The label model alone, from labels that are as wrong.
    classifier, model = toxicity.learn(id_and_text(docs), flipped)
    assert 0.6 < 1 - model.label_rates[0] < 0.95 and 0.6 < model.label_rates[1] < 0.95  # what it thinks of the labels
    held = docs.join(labels, "doc_id").filter(held_out("doc_id", toxicity.FOLDS) & F.col("toxic").isNotNull()).select("text", "toxic").collect()
    votes = np.array([classifier.hits.look(r["text"] or "")[0] > 0 for r in held], float)
    truth = np.array([r["toxic"] for r in held])
    p, q = 1 / (1 + np.exp(-model.logit(votes))), classifier([r["text"] or "" for r in held])
    loss = lambda s: -np.mean(np.log(np.clip(np.where(truth == 1, s, 1 - s), 1e-12, 1)))
    assert ((q >= 0.5) == truth).mean() >= ((p >= 0.5) == truth).mean() and loss(q) < loss(p)


def test_label_rates_and_accuracies_are_estimated():
    rng = np.random.default_rng(1)
    k, n = 6, 40_000
    hidden = rng.random(n) < 0.2
    rates = np.array([[0.02, 0.05, 0.01, 0.1, 0.03, 0.02], [0.6, 0.5, 0.3, 0.4, 0.7, 0.2]])
    votes = rng.random((n, k)) < rates[hidden.astype(int)]
    labels = np.where(rng.random(n) < 0.1, np.where(rng.random(n) < np.where(hidden, 0.75, 0.2), 1, 0), -1)
    patterns, count = np.unique(np.c_[votes, labels], axis=0, return_counts=True)
    model = toxicity.fit_label_model(patterns[:, :k].astype(float), patterns[:, k], count.astype(float))
    assert np.abs(model.rates - rates).max() < 0.05 and np.abs(model.label_rates - [0.2, 0.75]).max() < 0.05 and abs(model.prior - 0.2) < 0.03


def test_unlabelled_rows_are_learned_from(spark):
    """A word that no labelled row has, but that goes with insults in unlabelled ones, is no term; its company still counts."""
    rows = [(i, "a calm note about the harbour and its boats") for i in range(60)] + [(100 + i, "you are an idiot and a moron, shut up, hate you") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, none).collect()}
    assert max(scores[i] for i in range(60)) < 0.5 < min(scores[100 + i] for i in range(60))
    few = spark.createDataFrame([(1, 0), (2, 0), (101, 1), (102, 1)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(docs, few).collect()}
    assert max(scores[i] for i in range(60)) < 0.5 < min(scores[100 + i] for i in range(60))
