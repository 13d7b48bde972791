"""Operator 6: quality by random-indexing word vectors and a two-layer network.

A text's words are read in three ways: their letters in lower case, their shape
(letters by case, digits, marks; runs shortened) and whether they repeat the
word before. Each of these is hashed to one of a fixed number of entries, and
each entry has a sparse random index vector. An entry's word vector is the mean
of the index vectors around it, summed over all documents by Spark. A document
is the means of its words' vectors (letters, shapes and repeats apart), the
largest mean of any window of WINDOW words, and its length.

The network (one hidden layer) is trained in numpy on a bounded sample of
labelled rows: at most LABELLED of those outside the held-out fold, least hash
first. A tenth of them is set aside to choose the temperature that its
probabilities are divided by before the sigmoid.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0.
Null and empty texts have all-zero vectors and get the network's score for
those. Null ids are scored, not learned from, and count as held out. Repeated
rows each get their row. Several labels of one id: the least counts. With no
labels to learn from, every score is 0.5; with labels of one kind, their share.
An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, id_and_text, only_memory, parts_of, read_table, small_batches

LETTERS, SHAPES = 8192, 1024
SAME = LETTERS + SHAPES
ENTRIES = SAME + 1
DIMENSIONS, NONZERO = 24, 4
WINDOW = 32
FOLDS = 5
LABELLED = 20_000
HIDDEN = 24
EPOCHS = 60
THRESHOLD = 0.3
_REMEMBER = 300_000
_RUN = re.compile(r"(.)\1+")


class _Classes(dict):
    """For str.translate: letters as x or X, digits as 0, marks as they are."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = found = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        return found


_classes = _Classes()


def shape_of(word: str) -> str:
    """A word's classes of characters, with runs of one shortened."""
    return _RUN.sub(r"\1\1", word[:40].translate(_classes))


class _Entries(dict):
    """A word's two entries as one number; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > _REMEMBER:
            self.clear()
        letters = zlib.crc32(word.lower().encode(errors="surrogatepass")) % LETTERS
        shape = zlib.crc32(shape_of(word).encode(errors="surrogatepass")) % SHAPES
        self[word] = found = letters * SHAPES + shape
        return found


_entries = _Entries()


@cache
def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(17)
    out = np.zeros((ENTRIES, DIMENSIONS), np.float32)
    for row in out:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def read_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The entries of letters and of shapes, whether a word repeats the one before, and the number of words of each text."""
    only_memory("entries", _entries.clear)
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    get = _entries.__getitem__
    both = np.fromiter((get(w) for t in words for w in t), np.int64, counts.sum())
    letters = both // SHAPES
    same = np.r_[False, letters[1:] == letters[:-1]] if len(both) else np.zeros(0, bool)
    starts = np.cumsum(counts) - counts
    same[starts[counts > 0]] = False
    return letters, LETTERS + both % SHAPES, same, counts


def _around(letters: np.ndarray, shapes: np.ndarray, same: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of the index vectors of the two words on either side, within a text."""
    index = index_vectors()
    own = index[letters] + index[shapes] + same[:, None] * index[SAME]
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros_like(own)
    for k in (1, 2):
        out[k:] += own[:-k]
        out[:-k] += own[k:]
        over = np.flatnonzero(text[k:] != text[:-k])  # neighbours in different texts
        out[over + k] -= own[over]
        out[over] -= own[over + k]
    return out


def _add_by(total: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
    """Adds each row of x to the row of total that its id names."""
    order = np.argsort(ids.astype(np.uint16), kind="stable")  # a radix sort
    ids = ids[order]
    heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    total[ids[heads]] += np.add.reduceat(x[order], heads, axis=0)


def add_around(total: np.ndarray, texts: list[str]) -> None:
    """Adds what stands around each word to the rows of its entries."""
    letters, shapes, same, counts = read_words(texts)
    if len(letters):
        around = _around(letters, shapes, same, counts)
        _add_by(total, letters, around)
        _add_by(total, shapes, around)
        total[SAME] += around[same].sum(axis=0)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A vector of length one (or zero) for each entry, from all rows of docs (text)."""
    names = [f"x{j}" for j in range(DIMENSIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ENTRIES, DIMENSIONS))
        for batch in batches:
            for texts in parts_of(batch.column(0).to_pylist()):
                add_around(total, texts)
        used = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, j].astype(np.float32)) for j in range(DIMENSIONS))], ["i", *names])

    summed = docs.select("text").mapInArrow(run, "i int, " + ", ".join(f"{x} float" for x in names)).groupBy("i").agg(*(F.sum(x).alias(x) for x in names))
    out = np.zeros((ENTRIES, DIMENSIONS))
    for row in summed.collect():  # a row for each entry
        out[row["i"]] = row[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def _means(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean of each text's rows; zeros for none."""
    out = np.zeros((len(counts), x.shape[1]), np.float32)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        out[some] = np.add.reduceat(x, starts, axis=0) / counts[some, None]
    return out


def pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row for each text, made a few texts at a time: a word takes two vectors."""
    return np.concatenate([_pooled(part, vectors) for part in parts_of(texts)] or [_pooled([], vectors)])


def _pooled(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    letters, shapes, same, counts = read_words(texts)
    # Windows of WINDOW words, the last of a text shorter.
    windows = -(-counts // WINDOW)
    sizes = np.full(windows.sum(), WINDOW)
    ends, some = np.cumsum(windows), counts > 0
    sizes[ends[some] - 1] = counts[some] - (windows[some] - 1) * WINDOW
    width = vectors.shape[1] + 1
    sums, most, least = (np.zeros((len(counts), width), np.float32) for _ in range(3))
    if some.any():
        heads = np.cumsum(sizes) - sizes
        by_window = np.c_[np.add.reduceat(vectors[shapes], heads, axis=0), np.add.reduceat(same.astype(np.float32), heads)]
        starts = (ends - windows)[some]
        sums[some] = np.add.reduceat(by_window, starts, axis=0)
        by_window /= sizes[:, None]
        most[some] = np.maximum.reduceat(by_window, starts, axis=0)
        least[some] = np.minimum.reduceat(by_window, starts, axis=0)
    mean = sums / np.maximum(counts, 1)[:, None]
    return np.concatenate([_means(vectors[letters], counts), mean, most, least, np.log1p(counts)[:, None] / 8], axis=1).astype(np.float32)


class Network:
    """Two layers; p = sigmoid(logit / temperature)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray, seed: int = 5):
        self.constant = float(y.mean()) if len(y) and y.min() == y.max() else None if len(y) else 0.5
        if self.constant is not None:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array(np.log(y.mean() / (1 - y.mean())))]
        fit = ~aside if (~aside).any() and y[~aside].min() != y[~aside].max() else np.ones(len(y), bool)
        xs, ys = x[fit], y[fit]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            for i in np.array_split(rng.permutation(len(ys)), max(1, len(ys) // 128)):
                t += 1
                h = np.tanh(xs[i] @ self.w[0] + self.w[1])
                g = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - ys[i]) / len(i)
                back = g[:, None] * self.w[2] * (1 - h * h)
                grads = [xs[i].T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ g + 1e-4 * self.w[2], g.sum()]
                rate = 0.01 * (1 - epoch / EPOCHS)
                for j, grad in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.999 * v[j] + 0.001 * grad * grad
                    self.w[j] = self.w[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        held = aside if aside.any() else fit
        logits, target = self._logits(x[held]), y[held]
        loss = [np.logaddexp(0, -np.where(target > 0, logits, -logits) / c).mean() for c in _TEMPERATURES]
        self.temperature = float(_TEMPERATURES[int(np.argmin(loss))])

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logits = self._logits((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


_TEMPERATURES = np.geomspace(0.25, 8, 61)


def labelled(docs: DataFrame, labels: DataFrame, column: str, folds: int = FOLDS, most: int = LABELLED) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled ids outside the held-out fold, least hash first."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    own = own.filter(~held_out("doc_id", folds)).groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers


def apply_scores(docs: DataFrame, model: Callable[[list[str]], np.ndarray], threshold: float, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id", folds), F.lit(True)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


class QualityModel:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.network(pooled(texts, self.vectors))


def learn(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """docs: (doc_id, text)."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    # At most LABELLED ids.
    rows = labelled(docs, labels, "quality").select("doc_id", "text", "label").mapInArrow(features, "doc_id long, label int, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    width = pooled([], vectors).shape[1]
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, width).astype(np.float64)
    y = np.array([r["label"] for r in rows], np.float64)
    aside = np.array([zlib.crc32(b"aside%d" % r["doc_id"]) % 10 == 0 for r in rows], bool)
    return QualityModel(vectors, Network(x, y, aside))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    return apply_scores(docs, learn(docs, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are predicted to be good, with all their columns; no shuffle of the texts."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(id_and_text(docs), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = [t or "" for t in batch.column("text").cast(pa.string()).to_pylist()]
                yield batch.filter(pa.array(shared.value(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
