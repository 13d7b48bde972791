"""Operator 13: groups of spelling variants, by forward and backward minimal automata.

Two words that differ by one letter agree exactly on the first half of either or on
the rest of it: an error lies on one side of the middle. So each word is sent to the
words that may share its first half (forward) and to those that may share its second
half (backward). In each such cell the words are one minimal acyclic automaton whose
paths carry word numbers, in the backward cells of the words from last to first
letter. A word follows its exact half, then is completed in all ways with one error;
the number that its path has summed up says which word was found. A pair that shares
the first half is reported by the forward side alone, so nothing is found twice.

A cell is chosen by a hash of the half, for each length of half that a word's
neighbours can have (two a direction). A cell holds about CELL code points. One that
is larger, because very many words share a half, is dealt to parts: every part's
automaton meets every part's words, in cells of bounded size. Only counts and the best
neighbour of each word leave a cell. Words of over LONG code points, which would make
deep automata, are matched in their cell by hashes of the word without each letter,
and compared.

Chains of forms are followed by doubling: n grows tenfold with each form, so the
number of rounds follows from the largest n.

Null texts hold no words, as empty ones; a null doc_id is written as nothing before
the colon. Repeated rows count each. Texts and words of any length are taken whole.
Of neighbours with equal n the smallest in code-point order is the form. An empty
table gives an empty result. Columns other than doc_id and text are left behind,
whatever their names are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automata import Automaton, backward, long_pairs, matrix
from .common import cut, id_and_text, read_table, small_batches

#: Least code points and occurrences of a word; how much more frequent its form is; of crc32 values that many apart a letter goes.
LEAST, OFTEN, TIMES, EVERY = 7, 2, 10, 31
#: Code points of a cell; code points up to which words are in automata; distinct words that a task counts before it passes them on.
CELL, LONG, HELD = 1 << 18, 64, 200_000
# Maximal runs that can give a word: no letter is added to a run.
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST},}}")


def words_in(doc_id: int | None, text: str) -> Counter:
    """The words of a text, after letters are deleted by the rule, and how often each stands there."""
    found: Counter = Counter()
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():  # bytes lower A-Z only
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST:
                continue
        found[run] += n
    return found


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of documents that occur often enough."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_in(doc_id, text.as_py()).items():
                    held[word] += n
                if len(held) > HELD:
                    yield flush()
        yield flush()

    return id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)


def _first(length):
    """Code points of the half that is matched forward."""
    return F.floor(length / 2).cast("int")


def cells(words: DataFrame, size: int = CELL) -> DataFrame:
    """Adds side (0 forward, 1 backward), cell, a, b, part and own to (word, n).

    Within (side, cell, a, b) the words whose part is a are to be found, those whose
    part is b and that are own to be asked for.
    """
    spark = words.sparkSession
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * total // size)
    n = F.length("word")
    # Lengths of the halves of the words that are as long, or one shorter or longer.
    lengths = lambda half: F.array_distinct(F.transform(F.array(n - 1, n, n + 1), half))
    forward = F.transform(lengths(_first), lambda k: F.struct(F.lit(0).alias("side"), F.substring("word", F.lit(1), k).alias("half"), (k == _first(n)).alias("own")))
    rest = lambda m: m - _first(m)
    behind = F.transform(lengths(rest), lambda k: F.struct(F.lit(1).alias("side"), F.substring("word", n - k + 1, k).alias("half"), (k == rest(n)).alias("own")))
    rows = words.select("word", "n", F.explode(F.concat(forward, behind)).alias("k"))
    rows = rows.select("word", "n", "k.side", "k.own", F.pmod(F.xxhash64("k.side", "k.half"), F.lit(many)).cast("int").alias("cell"))
    weight = rows.groupBy("side", "cell").agg(F.sum(F.length("word")).alias("held"))
    # At most one row for each 2 * size code points of all words.
    large = cut(weight.filter(F.col("held") > 2 * size).select("side", "cell", F.ceil(F.col("held") / size).cast("int").alias("parts")))
    rows = rows.join(F.broadcast(large), ["side", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    found = F.transform(every, lambda b: F.struct(F.col("part").alias("a"), b.alias("b")))
    asked = F.transform(every, lambda a: F.struct(a.alias("a"), F.col("part").alias("b")))
    return rows.withColumn("at", F.explode(F.when(F.col("own"), F.array_union(found, asked)).otherwise(found))).select("word", "n", "side", "own", "cell", "part", "at.a", "at.b")


def _halves(pairs_first: np.ndarray, rows: np.ndarray, half: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the words `rows[pairs_first]` and `other` agree on the first half of the former."""
    behind = np.arange(rows.shape[1]) >= half[pairs_first, None]
    return ((rows[pairs_first] == other) | behind).all(axis=1)


def near_in_cell(words: list[bytes], asks: np.ndarray, held: np.ndarray, side: int, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): word i, which asks, has the near word j, which is held, and the pair is this side's to report."""
    length = np.array([len(w) for w in words], np.int64)
    short = np.flatnonzero(length <= long)
    rows = matrix([words[i] for i in short], long)
    turned = backward(rows, length[short]) if side else rows
    order = np.flatnonzero(held[short])
    order = order[np.argsort(turned[order].view(f"S{long}").ravel(), kind="stable")]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (turned[order][1:] != turned[order][:-1]).any(axis=1)  # a word may be in a cell twice
    order = order[fresh]
    ask = np.flatnonzero(asks[short])
    half = length[short] // 2
    exact = (length[short] - half if side else half)[ask]
    i, number = Automaton(turned[order]).near(turned[ask], length[short][ask], exact) if len(order) and len(ask) else (np.zeros(0, np.int64),) * 2
    i, j = ask[i], order[number]
    if side:
        own = ~_halves(i, rows, half, rows[j])
        i, j = i[own], j[own]
    i, j = short[i], short[j]
    far = np.flatnonzero(length >= long)
    if len(far):
        letters = [np.frombuffer(words[k], np.uint8) for k in far]
        more = set()
        for p, q in long_pairs(letters, asks[far], held[far]):
            x, y = letters[p], letters[q]
            k = len(x) // 2
            if max(len(x), len(y)) > long and np.array_equal(x[:k], y[:k]) != bool(side):
                more.add((words[far[p]], words[far[q]], int(far[p]), int(far[q])))
        once = {(a, b): (p, q) for a, b, p, q in more}
        i, j = np.r_[i, [p for p, _ in once.values()]].astype(np.int64), np.r_[j, [q for _, q in once.values()]].astype(np.int64)
    return i, j


def _search(key: tuple, table: pa.Table) -> pa.Table:
    """(word, n, n_near, form, form_n): of the words asked for in a cell, how many near ones it has and the best of them."""
    side, _, a, b = (k.as_py() for k in key)
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n, part = table.column("n").to_numpy(), table.column("part").to_numpy()
    asks = table.column("own").to_numpy() & (part == b)
    i, j = near_in_cell(words, asks, part == a, side)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort([rank[j], -n[j], i])
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[starts, len(i)])
    best, text = j[starts], table.column("word")
    # Every word once, from the first cell that asks for it.
    rest = np.setdiff1d(np.flatnonzero(asks), i) if side == 0 and a == 0 else np.zeros(0, np.int64)
    row = np.r_[i[starts], rest]
    none = np.arange(len(row)) >= len(starts)
    taken = np.r_[best, np.zeros(len(rest), np.int64)]
    return pa.table({
        "word": text.take(pa.array(row)), "n": pa.array(n[row]), "n_near": pa.array(np.r_[counts, np.zeros(len(rest), np.int64)]),
        "form": text.take(pa.array(taken, mask=none)), "form_n": pa.array(n[taken] if len(n) else taken, pa.int64(), mask=none),
    })


def near_words(words: DataFrame, size: int = CELL) -> DataFrame:
    """(word, n, n_near, best): each word of (word, n), how many are near it, and (n, word) of the best of them."""
    found = cells(words, size).groupBy("side", "cell", "a", "b").applyInArrow(_search, "word string, n long, n_near long, form string, form_n long")
    best = F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("word")))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of (word, form): the last form that can be reached, where n is at most `most`."""
    r = forms.select("word", F.col("form").alias("root"))
    steps = math.log(max(most, TIMES), TIMES)
    for _ in range(max(0, math.ceil(math.log2(steps)))):
        further = r.select(F.col("word").alias("root"), F.col("root").alias("further"))
        r = cut(r.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return r


def variants(docs: DataFrame, size: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of documents."""
    words = cut(count_words(docs))
    near = near_words(words, size)
    chosen = F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best"))
    rows = cut(near.withColumn("best", chosen).select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.less")).alias("form_n")))
    ends = roots(rows.filter("form is not null").select("word", "form"), words.agg(F.max("n")).first()[0] or 0)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))
