"""Operator 4: text scores of a log-bilinear model trained with noise-contrastive estimation.

Tokens are the white-space separated words of a text with A-Z in lower case,
then one end. Every token has a class: the SHORTLIST most frequent tokens are
classes of their own, all others fall into BINS classes by their last letters.
The log-bilinear model predicts a token's class from the two classes before it:

    s(w | a, b) = r_w . (C1 r_a + C2 r_b) + bias_w

It is trained in numpy, by noise-contrastive estimation with a pool of noise
shared by each batch. Every training document is used once, in ROUNDS rounds:
its class numbers are dealt by a hash to a shard of about SHARD tokens, whose
number follows from the count of tokens alone. In a round each shard trains from
the last model, in the order of the hashes and with a seed of its own, and Spark
averages the shards' parameters in whole numbers, exactly. So the model is a
function of the table, however its rows are laid out. Afterwards the model is normalised exactly: the
logarithms of the sums over all classes, for every pair of context classes, come
from batches of matrix products in their own Spark job.

A token of a bin class gets the class's probability times its share of the
bin's training tokens; the share of tokens that were seen once (Good-Turing) is
kept back for the unknown. So the probabilities of all V known tokens and the
unknown ones sum to one after any context.

Counts cover all training documents. The most frequent tokens, HEAD at most,
and their counts are known to every task; the rest is looked up by a join, exactly.

Null texts count as empty (one token, the end). Rows with a null doc_id are
scored but not learned from. Repeated rows each count and each give a row. An
empty table gives no row; with nothing to learn from, all tokens are unknown.
Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, held_out, id_and_text, read_table, small_batches

SHORTLIST, BINS = 768, 256
CLASSES = SHORTLIST + BINS
HEAD = 1 << 17
DIMENSIONS = 32
ROUNDS = 3
FOLDS = 10
NOISE = 128
BATCH = 2048
RATE = 0.05
#: Training tokens of a shard; parameters are averaged in steps of 1 / FINE.
SHARD = 1_000_000
FINE = 1 << 30
#: A task hands on its counts when it holds so many different words.
FLUSH = 1_000_000
END = b""
_PAD = 0.1


def tokens_of(text: str) -> list[bytes]:
    """The words of a text (bytes.lower and bytes.split know ASCII only), without the end."""
    return text.encode(errors="surrogatepass").lower().split()


def bin_of(word: bytes) -> int:
    return SHORTLIST + zlib.crc32(word[-3:]) % BINS


def _trained() -> Column:
    return ~F.coalesce(held_out("doc_id", FOLDS), F.lit(True))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(word, c) over all rows; the end's word is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(tokens_of(text))
                if len(found) > FLUSH:
                    yield rows()
                    found.clear()
            found[END] += batch.num_rows
        if found:
            yield rows()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0")


@dataclass
class Vocabulary:
    """What tasks know of the training tokens; its size doesn't depend on the input."""

    words: dict[bytes, int]  # of the head: place in `counts`, most frequent first
    counts: np.ndarray
    total: int
    distinct: int
    bins: np.ndarray  # training tokens of each bin
    once: np.ndarray  # of those, tokens seen once

    @property
    def class_counts(self) -> np.ndarray:
        own = np.zeros(SHORTLIST)
        own[: len(self.counts[:SHORTLIST])] = self.counts[:SHORTLIST]
        return np.concatenate([own, self.bins])

    def class_of(self) -> np.ndarray:
        """The class of each word of the head."""
        return np.array([i if i < SHORTLIST else bin_of(w) for w, i in self.words.items()], np.int32)

    def unknown_share(self) -> np.ndarray:
        return (self.once + 0.5) / (self.bins + 1.0)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, c): at most HEAD words and a number for each bin reach the driver."""
    # The head is chosen by how many words reach each step of a logarithmic scale (a row for each step).
    step = F.floor(F.log2("c") * 32)
    least, room = None, HEAD
    for s, n in counts.groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect():
        room -= n
        if room < 0:
            break
        least = s
    top = counts.filter((step >= least if least is not None else F.lit(False)) | (F.col("word") == F.lit(END))).collect()
    top.sort(key=lambda r: (-r["c"], bytes(r["word"]) != END, bytes(r["word"])))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # `bin_of` in Spark's functions, for all words.
    tail = F.col("word").substr(F.greatest(F.octet_length("word") - 2, F.lit(1)), F.lit(3))
    binned = counts.groupBy((F.crc32(tail) % BINS).cast("int").alias("bin")).agg(F.sum("c").alias("n"), F.count_if(F.col("c") == 1).alias("once")).collect()
    bins, once = np.zeros(BINS), np.zeros(BINS)
    for b, n, k in binned:
        bins[b], once[b] = n, k
    for row in top[:SHORTLIST]:  # these are classes of their own
        b = bin_of(bytes(row["word"])) - SHORTLIST
        bins[b] -= row["c"]
        once[b] -= row["c"] == 1
    return Vocabulary({bytes(r["word"]): i for i, r in enumerate(top)}, np.array([r["c"] for r in top], np.int64), int(total), int(distinct), bins, once)


class Bilinear:
    """Parameters as one matrix: rows of r and bias (last column), then C1 and C2."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.astype(np.float32)

    @classmethod
    def fresh(cls, class_counts: np.ndarray) -> Bilinear:
        rng = np.random.default_rng(7)
        d = DIMENSIONS
        rows = np.zeros((CLASSES + 2 * d, d + 1))
        rows[:CLASSES, :d] = rng.normal(0, 0.1, (CLASSES, d))
        rows[:CLASSES, d] = np.log(_shares(class_counts))
        rows[CLASSES:, :d] = np.concatenate([np.eye(d), np.eye(d)]) * 0.5
        return cls(rows)

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        d = DIMENSIONS
        return self.rows[:CLASSES, :d], self.rows[:CLASSES, d], self.rows[CLASSES : CLASSES + d, :d], self.rows[CLASSES + d :, :d]

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """r_w . C1 r_a + bias_w by (a, w), and r_w . C2 r_b by (b, w)."""
        r, bias, c1, c2 = self.parts
        return r @ c1.T @ r.T + bias, r @ c2.T @ r.T


def _shares(class_counts: np.ndarray) -> np.ndarray:
    return (class_counts + 1) / (class_counts.sum() + len(class_counts))


class Trainer:
    """Noise-contrastive steps with AdaGrad on one task's tokens."""

    def __init__(self, model: Bilinear, class_counts: np.ndarray, seed: int):
        self.r, self.bias, self.c1, self.c2 = (x.copy() for x in model.parts)
        self.past = [np.full_like(x, 1e-6) for x in (self.r, self.bias, self.c1, self.c2)]
        shares = _shares(class_counts)
        self.log_noise = np.log(shares * NOISE).astype(np.float32)
        self.up_to = np.cumsum(shares)
        self.rng = np.random.default_rng(seed)
        self.tokens = 0

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        n, d = len(w), DIMENSIONS
        ra, rb, rw = (np.take(self.r, x, axis=0) for x in (a, b, w))
        q = ra @ self.c1.T + rb @ self.c2.T
        noise = np.minimum(np.searchsorted(self.up_to, self.rng.random(NOISE)), CLASSES - 1)
        rn = self.r[noise]
        true = np.einsum("ij,ij->i", q, rw) + self.bias[w] - self.log_noise[w]
        false = q @ rn.T + (self.bias[noise] - self.log_noise[noise])
        # Gradients of the negative log-likelihood by the scores.
        g = (-1 / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)
        h = np.clip(false, -30, 30, out=false)
        np.exp(np.negative(h, out=h), out=h)
        h += 1
        np.reciprocal(h, out=h)
        dq = g[:, None] * rw + h @ rn
        # Rows of equal classes are added up side by side; a last column is the bias.
        where = np.concatenate([w, a, b, noise])
        what = np.zeros((len(where), d + 1), np.float32)
        np.multiply(g[:, None], q, out=what[:n, :d])
        np.matmul(dq, self.c1, out=what[n : 2 * n, :d])
        np.matmul(dq, self.c2, out=what[2 * n : 3 * n, :d])
        np.matmul(h.T, q, out=what[3 * n :, :d])
        what[:n, d], what[3 * n :, d] = g, h.sum(axis=0)
        order = np.argsort(where.astype(np.int16), kind="stable")  # by counting
        where = where[order]
        first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
        rows, sums = where[first], np.add.reduceat(np.take(what, order, axis=0), first, axis=0) / np.float32(n)
        for x, past, grad in zip((self.r, self.bias), self.past, (sums[:, :d], sums[:, d])):  # classes without a gradient stay
            past[rows] += grad * grad
            x[rows] -= RATE * grad / np.sqrt(past[rows])
        for x, past, grad in zip((self.c1, self.c2), self.past[2:], (dq.T @ ra, dq.T @ rb)):
            grad = (grad / n).astype(np.float32)
            past += grad * grad
            x -= RATE * grad / np.sqrt(past)
        self.tokens += n

    def rows(self) -> np.ndarray:
        d = DIMENSIONS
        zeros = np.zeros((d, 1), np.float32)
        return np.concatenate([np.c_[self.r, self.bias], np.c_[self.c1, zeros], np.c_[self.c2, zeros]])


class Reader:
    """Texts as class numbers; remembers words beyond the head up to a bound."""

    def __init__(self, voc: Vocabulary, class_of: np.ndarray):
        self.head, self.class_of, self.size = voc.words, class_of, len(voc.words)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The place of each word in the head, -1 beyond it."""
        return np.fromiter(map(self.head.get, words, repeat(-1)), np.int64, len(words))

    def classes(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        out = np.take(self.class_of, places, mode="wrap") if self.size else np.zeros(len(words), np.int32)
        beyond = np.flatnonzero(places < 0)
        out[beyond] = [bin_of(words[i]) for i in beyond.tolist()]
        return out


def _all_tokens(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of the texts one after another, and how many there are up to the end of each text."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        words += tokens_of(text)
        words.append(END)
        ends.append(len(words))
    return words, np.array(ends, np.int64)


def _contexts(classes: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two tokens before; the end's class before a text's first token."""
    a = np.r_[end, classes[:-1]] if len(classes) else classes
    b = np.r_[end, a[:-1]] if len(classes) else classes
    a[starts] = end
    b[starts] = end
    seconds = starts + 1
    b[seconds[seconds < len(b)]] = end
    return a, b


def as_classes(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, classes): the class numbers of each document's tokens, as 16-bit numbers; docs: (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            words, ends = _all_tokens(batch.column(1).to_pylist())
            if not words:
                continue
            classes = reader.classes(words, reader.places(words)).astype("<i2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends, prepend=0)), pa.array([c.tobytes() for c in np.split(classes, ends[:-1])], pa.binary())], ["doc_id", "n", "classes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, classes binary")


def _one_round(rows: DataFrame, model: Bilinear, class_counts: np.ndarray, end: int, seed: int) -> Bilinear:
    """The mean of what the shards make of the model, each weighted by its tokens; rows: (shard, hash, doc_id, n, classes)."""
    names = [f"x{j}" for j in range(DIMENSIONS + 1)]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("hash", "ascending"), ("doc_id", "ascending")])
        lengths = table.column("n").to_numpy()
        classes = np.concatenate([np.frombuffer(c.as_py(), "<i2") for c in table.column("classes")]).astype(np.int64)
        trainer = Trainer(model, class_counts, seed + ROUNDS * key[0].as_py())
        a, b = _contexts(classes, np.cumsum(lengths) - lengths, end)
        order = trainer.rng.permutation(len(classes))
        for lo in range(0, len(order), BATCH):
            i = order[lo : lo + BATCH]
            trainer.step(a[i], b[i], classes[i])
        fine = np.rint(trainer.rows().astype(np.float64) * FINE).astype(np.int64)
        return pa.table([pa.array(np.arange(len(fine), dtype=np.int32)), pa.array(np.full(len(fine), trainer.tokens, np.int64)), *(pa.array(c) for c in fine.T)], names=["i", "n", *names])

    trained = rows.groupBy("shard").applyInArrow(run, "i int, n long, " + ", ".join(f"{x} long" for x in names))
    # Sums of whole numbers don't depend on their order.
    sums = trained.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(x).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")).alias(x) for x in names))
    found = sorted(sums.collect(), key=lambda r: r["i"])  # one row for each of the model's
    return Bilinear(np.array([[int(r[x]) / r["n"] / FINE for x in names] for r in found])) if found else model


def train(docs: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Bilinear:
    """docs: the training rows (doc_id, text)."""
    model = Bilinear.fresh(voc.class_counts)
    if not voc.total:
        return model
    class_of = voc.class_of()
    shared = docs.sparkSession.sparkContext.broadcast((voc, class_of))  # HEAD words at most
    shards = max(1, round(voc.total / rounds / SHARD))
    rows = as_classes(docs, shared).withColumn("hash", F.xxhash64("doc_id", "classes"))
    # Every training document belongs to one round and one shard.
    place = F.pmod("hash", F.lit(rounds * shards))
    rows = cut(rows.withColumns({"round": place % rounds, "shard": F.floor(place / rounds).cast("int")}))
    for k in range(rounds):
        model = _one_round(rows.filter(F.col("round") == k).drop("round"), model, voc.class_counts, int(class_of[voc.words[END]]), k)
    return model


def normalisers(spark: SparkSession, model: Bilinear) -> np.ndarray:
    """log of the sum of exp s(w | a, b) over all classes w, by (a, b)."""
    shared = spark.sparkContext.broadcast(model.products())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (x.astype(np.float64) for x in shared.value)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            # exp(x + y) = exp(x) exp(y): sums over w for all pairs are a matrix product.
            top_one, top_two = one[ids].max(axis=1), two.max(axis=1)
            sums = np.exp(one[ids] - top_one[:, None]) @ np.exp(two - top_two[:, None]).T
            logs = np.log(sums) + top_one[:, None] + top_two
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in logs], pa.binary())], ["a", "logs"])

    rows = spark.range(0, CLASSES, numPartitions=8).mapInArrow(run, "a long, logs binary").collect()  # one for each class
    return np.stack([np.frombuffer(r["logs"], np.float64) for r in sorted(rows, key=lambda r: r["a"])])


_TAIL = pa.struct([("word", pa.binary()), ("bin", pa.int32()), ("n", pa.int64())])


def score(docs: DataFrame, counts: DataFrame, voc: Vocabulary, model: Bilinear) -> DataFrame:
    """A row per document; docs: (doc_id, text)."""
    spark = docs.sparkSession
    one, two = model.products()
    shared = spark.sparkContext.broadcast((voc, voc.class_of(), one, two, normalisers(spark, model)))
    below = float(np.log10(voc.total + _PAD * (voc.distinct + 1)))
    log_unknown, log_known = np.log10(voc.unknown_share()), np.log10(1 - voc.unknown_share())
    log_bins = np.log10(np.maximum(voc.bins, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, class_of, one, two, logs = shared.value
        reader, task = Reader(voc, class_of), TaskContext.get().partitionId()
        end = int(class_of[voc.words[END]]) if END in voc.words else 0
        head_base = np.log10(voc.counts + _PAD) - below
        head_share = np.log10(np.maximum(voc.counts, 1.0))
        in_bin = class_of >= SHORTLIST
        head_share = np.where(in_bin, head_share + (log_known - log_bins)[np.maximum(class_of - SHORTLIST, 0)], 0.0) if reader.size else head_share
        seen = 0
        for batch in batches:
            words, ends = _all_tokens(batch.column("text").to_pylist())
            if not words:
                continue
            lengths = np.diff(ends, prepend=0)
            starts = ends - lengths
            places = reader.places(words)
            classes = reader.classes(words, places)
            a, b = _contexts(classes, starts, end)
            by_class = (np.take(one, a * CLASSES + classes).astype(np.float64) + np.take(two, b * CLASSES + classes) - np.take(logs, a * CLASSES + b)) / np.log(10)
            known = places >= 0
            if reader.size:
                base = np.where(known, head_base[places], 0.0)
                by_class += np.where(known, head_share[places], 0.0)
            else:
                base = np.zeros(len(words))
            offsets, tail = [0], []
            for lo, n in zip(starts, lengths):
                rest = Counter(words[lo + i] for i in np.flatnonzero(~known[lo : lo + n]).tolist())
                tail += rest.items()
                offsets.append(len(tail))
            values = pa.StructArray.from_arrays([
                pa.array([w for w, _ in tail], pa.binary()), pa.array([bin_of(w) - SHORTLIST for w, _ in tail], pa.int32()), pa.array([n for _, n in tail], pa.int64()),
            ], fields=list(_TAIL))
            add = lambda x: pa.array(np.add.reduceat(x, starts))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([
                pa.array((task << 33) + seen + np.arange(len(ends))), batch.column("doc_id"), pa.array(lengths.astype(np.int64)),
                add(known.astype(np.int64)), add(base), add(by_class), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
            ], ["ref", "doc_id", "n_tokens", "known", "base", "score", "tail"])
            seen += len(ends)

    schema = "ref long, doc_id long, n_tokens long, known long, base double, score double, tail array<struct<word:binary,bin:int,n:long>>"
    # Row references are made once and then read again, so they stay the same.
    scored = cut(docs.mapInArrow(run, schema))
    tail = scored.select("ref", F.explode("tail").alias("t")).select("ref", "t.word", "t.bin", "t.n").join(counts, "word", "left")
    by_bin = lambda x: F.get(F.array(*map(F.lit, x.tolist())), F.col("bin"))
    tail = tail.select(
        "ref", "n", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + _PAD) - below)).alias("base"),
        (F.col("n") * F.when(F.col("c").isNull(), by_bin(log_unknown)).otherwise(F.log10("c") + by_bin(log_known - log_bins))).alias("score"),
    )
    sums = tail.groupBy("ref").agg(*(F.sum(x).alias(f"tail_{x}") for x in ("known", "base", "score")))
    both = lambda x: F.col(x) + F.coalesce(f"tail_{x}", F.lit(0))
    return scored.join(sums, "ref", "left").select(
        "doc_id", F.coalesce(held_out("doc_id", FOLDS), F.lit(True)).alias("held_out"), "n_tokens",
        both("known").cast("long").alias("n_known"), F.lit(voc.total).cast("long").alias("train_tokens"),
        both("base").alias("base_score"), both("score").alias("score"),
    )


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    learn = docs.filter(_trained())
    counts = cut(count_tokens(learn))
    voc = vocabulary(counts)
    return score(docs, counts, voc, train(learn, voc, rounds))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
