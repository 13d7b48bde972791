"""Operator 8: toxicity by weak supervision.

Many voters look at a text: fixed lexicons, patterns, and lexicons of whole words
and of word beginnings that labelled rows show to be telling (a binomial test
against all terms tried). A voter fires or not. A generative label model takes
the class as hidden and estimates, by expectation maximisation, how often each
voter fires on either class and how voters correlate within a class; voters that
repeat each other share their weight. The given labels are one more voter, heard on
labelled rows alone, whose accuracy on either class is estimated like the others'.
The model runs on the counts of the voters' patterns over all documents (at most
2 ** number of voters rows); labelled rows count once, with their label.

A linear classifier is then trained to give the label model's posterior from the
voters, their numbers of hits and the most telling terms: on at most LABELLED
labelled rows, and on all documents without a label, by pattern (the mean of their
features, weighted by their number; all together they weigh UNLABELLED times what
the labelled rows weigh).

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0.
Null and empty texts fire no voter and get the score that goes with that. Null
ids are scored, not learned from, and count as held out. Repeated rows each get
their row. Several labels of one id: the least counts. With no labels the fixed
lexicons and patterns decide. An empty table gives no row. Other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, id_and_text, read_table, small_batches
from .quality import LABELLED, apply_scores, labelled

FOLDS = 5
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)
#: Learned terms that are kept, and those that the classifier gives weights of their own.
TERMS, OWN_WEIGHT = 4096, 256
#: Weight of all unlabelled documents together, as a multiple of the labelled rows'.
UNLABELLED = 1.0
#: A label is never taken to be right on more than this share of a class.
SUREST = 0.995
FLUSH = 500_000
_REMEMBER = 400_000

# Words that insult.
MIND = "idiot idiots idiotic moron morons moronic stupid dumb dumbass fool foolish imbecile cretin dimwit halfwit brainless dense airhead nitwit simpleton".split()
WORTH = "loser losers pathetic scum worthless trash garbage clown disgusting filth filthy vermin pig rat parasite coward useless ugly creep freak lowlife rubbish failure disgrace".split()
VULGAR = "bastard bitch crap damn hell shit shitty fuck fucking fucker ass asshole piss dick prick whore slut".split()
OTHER = "idiota imbécil estúpido estúpida tonto basura asqueroso payaso dumm dummkopf blöd blödmann idiotin abschaum müll ekelhaft versager imbécile stupide crétin ordure minable clownesque dégoûtant débile".split()
ABUSE = re.compile(r"\b(?:shut up|hate (?:you|them|him|her)|get lost|go away and die|you make me sick|nobody likes you|(?:you|he|she|they) (?:are|is) (?:an?|such an?|the) \w+)\b")
THREAT = re.compile(r"\b(?:kill|hurt|hunt|destroy|beat|burn) (?:you|yourself|them|him|her)\b")

VOTERS = ("mind", "worth", "vulgar", "other", "abuse", "threat", "shouting", "words even", "words odd", *(f"begins {n}" for n in PREFIXES), "two hits")
_WORD = re.compile(r"[^\W\d_]+")
_FIXED = {w: i for i, words in enumerate((MIND, WORTH, VULGAR, OTHER)) for w in words}


def words_in(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(words: set[str]) -> set[str]:
    """A word as `=word`, the beginnings of longer ones as `4:word`."""
    out = {"=" + w for w in words}
    for n in PREFIXES:
        out.update(f"{n}:{w[:n]}" for w in words if len(w) > n)
    return out


class Hits(dict):
    """For each word the voters and terms that it hits; bounded."""

    def __init__(self, terms: list[str]):
        self.terms = {t: i for i, t in enumerate(terms)}

    def __missing__(self, word: str) -> tuple:
        if len(self) > _REMEMBER:
            self.clear()
        found = [(_FIXED[word], -1)] if word in _FIXED else []
        if (i := self.terms.get("=" + word)) is not None:
            found.append((7 + zlib.crc32(word.encode(errors="surrogatepass")) % 2, i))
        for k, n in enumerate(PREFIXES):
            if len(word) > n and (i := self.terms.get(f"{n}:{word[:n]}")) is not None:
                found.append((9 + k, i))
        self[word] = out = tuple(found)
        return out

    def __reduce__(self):
        return Hits, (list(self.terms),)

    def look(self, text: str) -> tuple[np.ndarray, list[int], int]:
        """How often each voter fires on the text, the terms in it, and its number of different words."""
        hits, terms, telling = np.zeros(len(VOTERS), np.int64), [], 0
        words = words_in(text)
        for found in filter(None, map(self.__getitem__, words)):
            telling += 1
            for voter, term in found:
                hits[voter] += 1
                if term >= 0:
                    terms.append(term)
        if "you" in words or not words.isdisjoint(("shut", "hate", "get", "kill", "hurt", "hunt", "destroy", "beat", "burn", "die", "are", "is", "likes")):
            low = text.lower()
            hits[4] = len(ABUSE.findall(low))
            hits[5] = len(THREAT.findall(low))
        hits[6] = text.count("!!!") + (len(text) >= 40 and text.isupper())
        hits[-1] = telling >= 2
        return hits, terms, len(words)


def telling_terms(labelled_docs: DataFrame, most: int = TERMS) -> list[str]:
    """Terms that go with label 1 far more often than chance allows among all that were tried, the most telling first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        toxic: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64()), pa.array([toxic[t] for t in n], pa.int64())], ["term", "n", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(words_in(text))
                n.update(found)
                n[""] += 1
                if label:
                    toxic.update(found)
                    toxic[""] += 1
                if len(n) > FLUSH:
                    yield rows()
                    n.clear()
                    toxic.clear()
        if n:
            yield rows()

    counts = cut(labelled_docs.select("text", "label").mapInArrow(run, "term string, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")))
    total = counts.filter("term = ''").first()
    if total is None or not total["toxic"] or total["toxic"] == total["n"]:
        return []
    tried, base = counts.count(), total["toxic"] / total["n"]
    share = F.col("toxic") / F.col("n")
    # n times the divergence of the term's share from the base share bounds the logarithm of the chance.
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    weight = F.col("n") * (share * F.log(share / base) + rest)
    found = counts.filter("term != '' and toxic >= 3").filter(share > max(0.5, base)).withColumn("weight", weight).filter(F.col("weight") > float(np.log(tried) + 2))
    return [r["term"] for r in found.orderBy(F.desc("weight"), "term").limit(most).collect()]


@dataclass
class LabelModel:
    """Firing rates of the voters on either class, their correlations, and the weights that follow; how often a label is 1 on either class."""

    rates: np.ndarray  # 2 x voters
    prior: float
    weights: np.ndarray
    correlations: np.ndarray = field(repr=False)
    label_rates: np.ndarray = field(default_factory=lambda: np.array([0.1, 0.9]))

    def evidence(self, labels: np.ndarray) -> np.ndarray:
        """What labels of 1 and 0 add to the logit; others (-1) add nothing."""
        zero, one = self.label_rates
        return np.where(labels == 1, np.log(one / zero), np.where(labels == 0, np.log((1 - one) / (1 - zero)), 0.0))

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(votes) + self.evidence(labels), -50, 50)))

    def logit(self, votes: np.ndarray) -> np.ndarray:
        one, zero = np.log(self.rates), np.log(1 - self.rates)
        each = np.where(votes, one[1] - one[0], zero[1] - zero[0])
        return np.log(self.prior / (1 - self.prior)) + each @ self.weights


def fit_label_model(votes: np.ndarray, labels: np.ndarray, n: np.ndarray, rounds: int = 100) -> LabelModel:
    """votes: patterns x voters; labels: 1, 0 or -1 for none; n: how many documents have both."""
    k = votes.shape[1]
    known = labels >= 0
    model = LabelModel(np.array([np.full(k, 0.02), np.full(k, 0.3)]), 0.1, np.ones(k), np.eye(k))
    for _ in range(rounds):
        p = model.posterior(votes, labels)
        mass = np.array([((1 - p) * n).sum(), (p * n).sum()])
        shares = [(1 - p) * n, p * n]
        # A voter is expected to fire more on toxic texts: as many thoughts of documents as keep rates inside (0, 1).
        rates = np.array([(s @ votes + a) / (m + 1) for s, m, a in zip(shares, mass, (0.02, 0.3))]).clip(1e-6, 1 - 1e-6)
        together = np.zeros((k, k))
        for s, m, r in zip(shares, mass, rates):
            apart = votes - r
            cov = (apart * s[:, None]).T @ apart / max(m, 1)
            sd = np.sqrt(np.diag(cov)) + 1e-3
            together = np.maximum(together, cov / sd[:, None] / sd)
        np.fill_diagonal(together, 1)
        prior = float(np.clip((mass[1] + 0.1) / (mass.sum() + 1), 1e-4, 0.9))
        # Labels are taken to be right on nine of ten rows until rows speak for more or less.
        right = np.array([((x * known) @ (labels == 1) + first) / ((x * known).sum() + 1) for x, first in zip(shares, (0.1, 0.9))]).clip(1 - SUREST, SUREST)
        new = LabelModel(rates, prior, 1 / np.clip(together, 0, 1).sum(axis=1), together, right)
        done = max(np.abs(new.rates - model.rates).max(), np.abs(right - model.label_rates).max()) < 1e-6
        model = new
        if done:
            break
    return model


class ToxicityModel:
    def __init__(self, terms: list[str], weights: np.ndarray, bias: float):
        self.hits, self.own, self.weights, self.bias = Hits(terms), len(terms[:OWN_WEIGHT]), weights, bias

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            out[i] = features(*self.hits.look(text), self.own) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def features(hits: np.ndarray, terms: list[int], words: int, own: int) -> np.ndarray:
    k = len(hits)
    x = np.zeros(3 * k + own)
    x[:k] = hits > 0
    x[k : 2 * k] = np.log1p(hits)
    x[2 * k : 3 * k] = hits * 20 / (words + 20)
    for t in terms:
        if t < own:
            x[3 * k + t] = 1
    return x


def fit_linear(x: np.ndarray, p: np.ndarray, n: np.ndarray, rounds: int = 25, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels by Newton's method; n: the rows' weights."""
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (n * (q * (1 - q) + 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (n * (q - p)) + penalty * w)
        w = w - step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _mask(hits: np.ndarray) -> int:
    """The pattern of the voters that fire."""
    return int((hits > 0) @ (1 << np.arange(len(hits))))


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[ToxicityModel, LabelModel]:
    """The classifier and the label model behind it; docs: (doc_id, text)."""
    spark = docs.sparkSession
    sample = labelled(docs, labels, "toxic", FOLDS, most)
    terms = telling_terms(sample)
    hits, own = Hits(terms), len(terms[:OWN_WEIGHT])
    shared = spark.sparkContext.broadcast(hits)  # TERMS words at most

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = shared.value.look(text)
                found[mask := _mask(seen[0])] += 1
                if mask:  # without a hit all features are 0
                    sums[mask] = sums.get(mask, 0) + features(*seen, own)
        rows = [(m, -1, float(n)) for m, n in found.items()] + [(m, int(i), float(x[i])) for m, x in sums.items() for i in np.flatnonzero(x)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["mask", "at", "total"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(*shared.value.look(t), own).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["doc_id", "label", "x"])

    # All documents, a row for each pattern and feature; then the labelled ones, at most `most` ids.
    totals = docs.select("text").mapInArrow(patterns, "mask int, at int, total double").groupBy("mask", "at").agg(F.sum("total").alias("total")).collect()
    rows = sample.select("doc_id", "text", "label").mapInArrow(look, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    k, width = len(VOTERS), 3 * len(VOTERS) + own
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, width).astype(np.float64)
    y = np.array([r["label"] for r in rows], np.int64)
    # What all documents have, less the labelled ones.
    masks = sorted({r["mask"] for r in totals})
    at = {m: i for i, m in enumerate(masks)}
    n, means = np.zeros(len(masks)), np.zeros((len(masks), width))
    for r in totals:
        if r["at"] < 0:
            n[at[r["mask"]]] = r["total"]
        else:
            means[at[r["mask"]], r["at"]] = r["total"]
    for row in x:
        i = at[_mask(row[:k])]
        n[i] -= 1
        means[i] -= row
    left = n > 0.5
    n, means = n[left], means[left] / n[left][:, None]
    bits = (np.array(masks, np.int64)[left][:, None] >> np.arange(k) & 1).astype(np.float64).reshape(-1, k)
    votes = np.concatenate([bits, x[:, :k]])
    model = fit_label_model(votes, np.r_[np.full(len(n), -1), y], np.r_[n, np.ones(len(x))])
    if len(x):
        p = model.posterior(votes, np.r_[np.full(len(n), -1), y])
        weight = np.r_[n * (UNLABELLED * len(x) / max(n.sum(), 1)), np.ones(len(x))]
        return ToxicityModel(terms, *fit_linear(np.concatenate([means, x]), p, weight)), model
    # Nothing is labelled: the label model is linear in the votes.
    one, zero = np.log(model.rates), np.log(1 - model.rates)
    weights = np.zeros(3 * len(VOTERS) + own)
    weights[: len(VOTERS)] = ((one[1] - one[0]) - (zero[1] - zero[0])) * model.weights
    return ToxicityModel(terms, weights, float(model.logit(np.zeros((1, len(VOTERS))))[0])), model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    return apply_scores(docs, learn(docs, labels)[0], threshold, FOLDS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
