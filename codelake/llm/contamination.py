"""Operator 5: benchmark items inside documents, by size-partitioned MinHash containment search.

Items are parted by size: class c holds those of more than 2^(c-1) and up to 2^c
runs of five words. For each class that occurs, documents are read in segments
of 2^(c+1) runs that start every 2^c runs, so any place where an item may stand
lies whole inside one segment and the two differ in size by a known factor only.
That turns the containment threshold into a least Jaccard similarity J between
item and segment, and into the number k of hash functions for which a segment
that reaches it agrees with the item at one function or more but for a chance
of MISS: (1 - J)^k <= MISS. The least values of a class's segments come from
those of blocks of half their length, which come from the next smaller class.

Segments that agree give candidate pairs of document and item, which are
verified exactly: the share of the item's runs that the document holds.

The items' signatures (k numbers an item) go to the tasks by broadcast while
they are under MOST_SIGNATURES numbers; beyond that, segment signatures are
joined with them by key. Both give the same rows.

Null and empty documents hold no item. Items of under five words (null ones
too) have no run of five and are never found: a single word stands in too many
clean documents. Very long texts are read whole. Repeated rows give repeated pairs
once, and of rows that share an id any one that holds the item counts. Ids that are
null are left out. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, small_batches
from .shingles import WORDS, mix, seeded, shingle_hashes, split_by, words_of

THRESHOLD = 0.8
MISS = 1e-5
MOST_SIGNATURES = 2_000_000
#: Up to so many candidate pairs (16 MB) go to the texts; beyond that the texts are shuffled to them.
MOST_PAIRS = 1_000_000


def functions_for(threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """How many hash functions a class needs: the item is over half of 2^c, the segment up to 2^(c+1)."""
    item, segment = 0.5, 2.0
    j = threshold * item / (segment + (1 - threshold) * item)
    return int(np.ceil(np.log(miss) / np.log(1 - j)))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def _runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of five words; texts of fewer words have none."""
    words = [words_of(t) for t in texts]
    return shingle_hashes([w if len(w) >= WORDS else [] for w in words])


def _values(runs: np.ndarray, f: int, out: np.ndarray | None = None) -> np.ndarray:
    """The f-th order of the runs. They are hashes already, so an exclusive or and an odd factor deal them anew."""
    out = np.bitwise_xor(runs, seeded(500 + f), out=out)
    return np.multiply(out, seeded(7500 + f) | np.uint64(1), out=out)


def _key(least: np.ndarray, c: int, f: int) -> np.ndarray:
    return mix(least ^ seeded(9000 + 100 * c + f)).view(np.int64)


def item_signatures(items: list[tuple[int, str | None]], k: int) -> list[tuple[int, int, int]]:
    """(size class, key, item) for each hash function of each item."""
    runs, counts = _runs([text for _, text in items])
    out = []
    for (item, _), own in zip(items, split_by(runs, counts)):
        own = np.unique(own)
        if len(own) and item is not None:
            c = int(size_class(np.array([len(own)]))[0])
            out += [(c, int(_key(_values(own, f).min(keepdims=True), c, f)[0]), item) for f in range(k)]
    return out


def segment_keys(texts: list[str | None], classes: list[int], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(class, index of the text for each segment, keys) for each hash function."""
    runs, counts = _runs(texts)
    if not len(runs):
        return
    block = 1 << classes[0]
    each = -(-counts // block)  # blocks of each text
    first = np.cumsum(counts) - counts
    starts = np.repeat(first, each) + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * block
    text = np.repeat(np.arange(len(counts)), each)
    values = np.empty_like(runs)
    for f in range(k):
        least, owner = np.minimum.reduceat(_values(runs, f, values), starts), text
        for c in range(classes[0], classes[-1] + 1):
            if c > classes[0]:  # two blocks of the class below make one of this; a text's last may stand alone
                place = np.arange(len(owner)) - np.searchsorted(owner, owner)
                heads = np.flatnonzero(place % 2 == 0)
                least, owner = np.minimum.reduceat(least, heads), owner[heads]
            if c in classes:
                after = np.r_[owner[1:] == owner[:-1], False]
                both = np.where(after, np.minimum(least, np.r_[least[1:], least[-1:]]), least)
                yield c, owner, _key(both, c, f)


def candidates(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, most: int = MOST_SIGNATURES) -> DataFrame:
    """(doc_id, item_id) pairs of which a segment's signature and the item's agree somewhere."""
    spark = docs.sparkSession
    k = functions_for(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = item_signatures(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), k)
            c, key, item = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(key, pa.int64()), pa.array(item, pa.int64())], ["c", "key", "item_id"])

    signed = cut(items.mapInArrow(sign, "c int, key long, item_id long"))
    classes = sorted(r["c"] for r in signed.select("c").distinct().collect())  # one for each power of two
    if not classes:
        return spark.createDataFrame([], "doc_id long, item_id long")

    if signed.count() <= most:
        order = np.array([(r["key"], r["item_id"]) for r in signed.select("key", "item_id").collect()], np.int64)
        order = order[np.argsort(order[:, 0], kind="stable")]
        held = spark.sparkContext.broadcast((order[:, 0].copy(), order[:, 1].copy()))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, owners = held.value
            for batch in batches:
                ids, pairs = batch.column(0).to_numpy(), set()
                for _, text, key in segment_keys(batch.column(1).to_pylist(), classes, k):
                    lo = np.searchsorted(keys, key)
                    for s in np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key):
                        at = lo[s]
                        while at < len(keys) and keys[at] == key[s]:
                            pairs.add((int(ids[text[s]]), int(owners[at])))
                            at += 1
                a, b = zip(*pairs) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["doc_id", "item_id"])

        return docs.mapInArrow(find, "doc_id long, item_id long").distinct()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for _, text, key in segment_keys(batch.column(1).to_pylist(), classes, k):
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), pa.array(key)], ["doc_id", "key"])

    return docs.mapInArrow(spread, "doc_id long, key long").join(signed, "key").select("doc_id", "item_id").distinct()


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, most: int = MOST_SIGNATURES) -> DataFrame:
    """(doc_id, item_id, n_runs, containment) of all documents that hold `threshold` or more of an item's runs."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id is not null")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("item")).filter("item_id is not null")
    pairs = cut(candidates(docs, items, threshold, most))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(r) for r in split_by(*_runs(batch.column("item").to_pylist()))]
            all_ = split_by(*_runs(batch.column("text").to_pylist()))
            n = np.array([len(r) for r in own], np.int64)
            share = np.array([np.isin(r, t).mean() if len(r) else 0.0 for r, t in zip(own, all_)])
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(n), pa.array(share, pa.float64())], ["doc_id", "item_id", "n_runs", "containment"])
            yield rows.filter(pa.array(share >= threshold))

    few = pairs.count() <= MOST_PAIRS
    held = docs.join(F.broadcast(pairs) if few else pairs, "doc_id").join(items, "item_id").select("doc_id", "item_id", "text", "item")
    return held.mapInArrow(measure, "doc_id long, item_id long, n_runs long, containment double").groupBy("doc_id", "item_id").agg(F.max("n_runs").alias("n_runs"), F.max("containment").alias("containment"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
