"""Operator 1: near-duplicate documents by DartMinHash signatures and banding.

A document is the set of its runs of five lower-case words (or, with
`weights="count"`, a weight for each: how often it occurs). Every run owns a
region as high as its weight, and hashed darts fall on it at the times of a
Poisson process; each dart also carries the coordinate it is for. A signature
keeps, for each of `bands * rows` coordinates, the earliest dart on any of the
document's regions, so two signatures agree at a coordinate with the probability
of the (weighted) Jaccard similarity. Darts are thrown only up to the time at
which a document may expect every coordinate to be hit, which is sooner the more
runs it has: the work is one look at each run and about k ln k darts a document,
not k looks at each run.

Documents with equal words form a class at once and are represented by their
least doc_id. Representatives that agree on a band share a bucket. Every member
is compared with its bucket's least member by exact Jaccard similarity of runs
(linked from `threshold` on), and components are taken. Buckets that still hold
several components go through a second pass: in blocks of bounded size, every two
members that aren't joined yet and whose sketches agree on `least_share` or more
are compared exactly, within the block's task, so that no list of a bucket's pairs
is made. Of pairs with a similarity of 0.8 sketches part about one in 10,000; a
`least_share` of 0 compares all of them. With `weights="count"` the similarity is the
weighted one: the sum of the lesser counts over that of the greater ones.

Null, empty and blank texts have no words: they link with nothing and are kept.
Texts of one to four words have one run, all their words. Very long texts are read
whole. Repeated rows share a doc_id and so a class, of which all or none are kept.
Rows with a null doc_id are in no class and kept. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import paired_blocks
from .common import cut, id_and_text, read_table, small_batches
from .components import components
from .shingles import mix, seeded, shingle_hashes, split_by, words_of

BANDS, ROWS = 20, 4
THRESHOLD = 0.8
#: A pair of sketches that agrees on less than this share isn't worth an exact comparison.
LEAST_SHARE = 0.62
BLOCK = 1500
#: A text counts as one row of a block for each so many characters, and so many runs are looked up at once.
ROW_CHARS, LOOK = 8192, 1_000_000


def throw_darts(runs: np.ndarray, counts: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """A row of k values for each document; documents without runs get zeros.

    runs: hashes, document after document; counts: how many each has; weights:
    of each run, 1 if not given.
    """
    out = np.zeros((len(counts), k), np.uint64)
    if weights is not None:  # regions of height 1, the last one of what is left
        strips = np.ceil(weights).astype(np.int64)
        height = np.ones(strips.sum())
        height[np.cumsum(strips) - 1] = weights - strips + 1
        level = (np.arange(len(height)) - np.repeat(np.cumsum(strips) - strips, strips)).astype(np.uint64)
        counts = np.add.reduceat(strips, np.cumsum(counts) - counts) * (counts > 0) if len(runs) else counts
        runs = np.repeat(runs, strips)
        runs = np.where(level > 0, mix(runs ^ (level * seeded(11))), runs)
    else:
        height = None
    todo = np.flatnonzero(counts)
    until = k * (np.log(k) + 3.0) / np.maximum(counts, 1)
    doc_of = np.repeat(np.arange(len(counts)), counts)
    chosen = slice(None)
    while len(todo):
        h, doc = runs[chosen], doc_of[chosen]
        high = None if height is None else height[chosen]
        best = _earliest(h, doc, high, until, len(counts), k, todo)
        full = (best != 0).all(axis=1)
        out[todo[full]] = best[full]
        todo = todo[~full]
        until[todo] *= 2
        left = np.zeros(len(counts), bool)
        left[todo] = True
        chosen = left[doc_of] if len(todo) else slice(0, 0)
    return out


def _earliest(h: np.ndarray, doc: np.ndarray, height: np.ndarray | None, until: np.ndarray, n: int, k: int, todo: np.ndarray) -> np.ndarray:
    row = np.zeros(n, np.int64)
    row[todo] = np.arange(len(todo))
    times, places, values = [], [], []
    at = np.zeros(len(h))
    limit = until[doc]
    j = 0
    while len(h):
        j += 1
        noise = mix(h ^ seeded(1000 + j))
        at = at - np.log((noise >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        hit = at <= limit
        h, doc, at, limit = h[hit], doc[hit], at[hit], limit[hit]
        height = None if height is None else height[hit]
        value = mix(h + mix(np.array([j], np.uint64)))
        kept = slice(None) if height is None else (mix(value ^ seeded(13)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < height
        times.append(at[kept])
        places.append(row[doc[kept]] * k + (value[kept] % np.uint64(k)).astype(np.int64))
        values.append(mix(value[kept]) | np.uint64(1))
    best = np.zeros(len(todo) * k, np.uint64)
    if times:
        order = np.argsort(np.concatenate(times))[::-1]
        best[np.concatenate(places)[order]] = np.concatenate(values)[order]  # the earliest is written last
    return best.reshape(-1, k)


def signatures(texts: list[str], bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> tuple[list[list[str]], np.ndarray]:
    """The words of each text and its signature."""
    words = [words_of(t) for t in texts]
    runs, counts = shingle_hashes(words)
    if weights == "set":  # a run that recurs throws the same darts again
        return words, throw_darts(runs, counts, bands * rows)
    each = [np.unique(r, return_counts=True) for r in split_by(runs, counts)]
    flat = np.concatenate([e[0] for e in each]) if each else runs
    heights = np.concatenate([e[1] for e in each]).astype(np.float64) if each else np.empty(0)
    return words, throw_darts(flat, np.array([len(e[0]) for e in each], np.int64), bands * rows, heights)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, weights: str = "set") -> DataFrame:
    """doc_id, digest (of the words), bands, sketch; all null but doc_id where there are no words."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, made = signatures(batch.column(1).to_pylist(), bands, rows, weights)
            keys = np.zeros((len(made), bands), np.uint64)
            for r in range(rows):
                keys = mix(keys ^ made[:, r::rows][:, :bands]) if len(made) else keys
            digests = [hashlib.blake2b(" ".join(w).encode(errors="surrogatepass"), digest_size=16).digest() if w else None for w in words]
            short = made.astype("<u2")
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(digests, pa.binary()),
                pa.array([k.view(np.int64) if w else None for k, w in zip(keys, words)], pa.list_(pa.int64())),
                pa.array([s.tobytes() if w else None for s, w in zip(short, words)], pa.binary()),
            ], ["doc_id", "digest", "bands", "sketch"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, digest binary, bands array<long>, sketch binary")


def run_sets(texts: list[str], weights: str = "set") -> list[np.ndarray]:
    """The runs of each text as sets, sorted. With weights "count" the k-th time that a run occurs is an element of
    its own, so that the Jaccard similarity of the sets is the weighted one of the counts."""
    sets = []
    for runs in split_by(*shingle_hashes([words_of(t) for t in texts])):
        if weights == "count":
            runs = np.sort(runs)
            again = (np.arange(len(runs)) - np.searchsorted(runs, runs)).astype(np.uint64)
            runs = np.where(again > 0, mix(runs ^ (again * seeded(17))), runs)
        sets.append(np.unique(runs))
    return sets


def verify(pairs: DataFrame, docs: DataFrame, threshold: float, weights: str = "set") -> DataFrame:
    """The pairs (a, b) whose texts have a (weighted) Jaccard similarity of runs of `threshold` or more."""
    ids = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("doc_id"))
    texts = id_and_text(docs).join(ids, "doc_id")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, text_a, text_b = (batch.column(n) for n in ("a", "b", "text_a", "text_b"))
            sets = [run_sets(column.to_pylist(), weights) for column in (text_a, text_b)]
            like = []
            for x, y in zip(*sets):
                both = len(np.intersect1d(x, y, assume_unique=True))
                like.append(both > 0 and both >= threshold * (len(x) + len(y) - both))
            mask = pa.array(like, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def _block_links(members: DataFrame, threshold: float, weights: str, least_share: float) -> DataFrame:
    """Pairs of `threshold` or more that join each block's components as far as any of its pairs do."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        tree = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        sketch = np.stack([np.frombuffer(s, "<u2") for s in table.column("sketch").to_pylist()])
        own = run_sets(table.column("text").to_pylist(), weights)
        sizes = np.array([len(r) for r in own], np.int64)
        runs = np.unique(np.concatenate(own), return_inverse=True)[1]  # numbered within the block
        starts = np.cumsum(sizes) - sizes
        held = np.zeros(len(runs), bool)
        a, b = [], []
        for i in range(len(ids) - 1):
            near = np.flatnonzero(tree[i + 1 :] != tree[i]) + i + 1
            near = near[(sketch[near] == sketch[i]).mean(axis=1, dtype=np.float32) >= least_share]
            held[runs[starts[i] : starts[i] + sizes[i]]] = True
            for part in np.split(near, np.flatnonzero(np.diff(np.cumsum(sizes[near]) // LOOK)) + 1):
                part = part[tree[part] != tree[i]]
                if not len(part):
                    continue
                n = sizes[part]
                first = np.cumsum(n) - n
                both = np.add.reduceat(held[runs[np.repeat(starts[part] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
                like = part[both >= threshold * (sizes[i] + n - both)]
                like = like[np.unique(tree[like], return_index=True)[1]]  # one of each component
                a.append(np.maximum(ids[i], ids[like]))
                b.append(np.minimum(ids[i], ids[like]))
                tree[np.isin(tree, tree[like])] = tree[i]
            held[runs[starts[i] : starts[i] + sizes[i]]] = False
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.groupBy("band", "key", "block_a", "block_b").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, weights: str = "set", least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), kept (whether it stays): a row for each row."""
    signed = cut(sign(docs, bands, rows, weights))
    # Equal words: one representative. Grouped by digest with a partial step, so no group is gathered.
    equal = signed.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    equal = cut(equal)
    keys = equal.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut(keys.join(shared, ["band", "key"]))
    stars = members.filter("id != least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    links = cut(verify(stars, docs, threshold, weights))
    groups = components(links)

    placed = members.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("band", "key")
    open_ = cut(placed.join(several, ["band", "key"]).select("band", "key", "id", "component"))
    needed = equal.select("id", "sketch").join(open_.select("id").distinct(), "id")
    texts = id_and_text(docs).withColumnRenamed("doc_id", "id")
    sizes = texts.select("id", F.greatest(F.lit(1.0), F.length("text") / ROW_CHARS).alias("weight")).groupBy("id").agg(F.sum("weight").alias("weight"))
    blocks = paired_blocks(open_.join(sizes, "id"), ["band", "key"], "id", BLOCK, "weight").drop("weight")
    groups = components(links.union(_block_links(blocks.join(texts.join(needed, "id"), "id"), threshold, weights, least_share)))

    classes = equal.select("digest", "id").join(groups, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("component", "id").alias("class_id"))
    out = signed.select("doc_id", "digest").join(classes, "digest", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
