"""Operator 3: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Vectors with equal labels and the same direction become one class with a count, so
exact copies, however many, cost one row from there on. Classes are coded: their
unit vectors are turned by rotations that are learned on a bounded sample (at most
SAMPLE rows, chosen by hash), principal axes first and then rounds that fit the
rotation to the signs (iterative quantisation), which balances the bits. The signs
are the code; each run of `bits` of them is the key of one Hamming table, and as
many rotations are learned as the tables need components.

How many bits and tables there are follows from the count of vectors of the largest
label and from the threshold alone (`plan`): a bucket holds a fourth of a vector on
average, and two vectors at the very threshold, whose bits differ with the
probability of their angle over pi, share a bucket of at least one table but for a
chance of MISS. Closer pairs are missed more rarely still. No vector looks up any
bucket but its own, so the work for each grows with the tables (their number with
the logarithm of the count), whatever the dimension is.

Within a bucket, SKETCH further bits of code are compared first, to send on only
the vectors that have a partner within a Hamming distance that all but about one in
10,000 pairs at the threshold keep. Those are compared with their original vectors
in double precision, so no pair below the threshold is linked. Buckets of any size
are dealt to blocks of bounded size. A pair counts in the first table that it shares.
Only counts and, of each block, a spanning forest of its links leave the task.

Vectors are compared only if their labels are equal and not null and they have the
same number of components. Vectors that are null, empty, zero or hold null or
non-finite components link with nothing, nor do rows without a vec_id. Repeated rows
count once and get the same result each; rows that share a vec_id with other contents
are vectors of their own. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from .blocks import dealt
from .common import cut, read_table
from .components import components

THRESHOLD = 0.98
#: Chance that two vectors at the threshold share no bucket.
MISS = 0.001
SAMPLE = 20_000
TURNS = 30
LEAST_BITS, MOST_BITS, MOST_TABLES = 6, 30, 64
SKETCH = 128
#: Vectors of one side in a block of a large bucket, of all small buckets in a block, and numbers compared at a time.
BLOCK, TOGETHER, NUMBERS = 4096, 8192, 6_000_000
_GROUP = ["d", "place", "block_a", "block_b"]


def plan(count: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a table, tables) for so many vectors of a label."""
    flip = np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi
    bits = int(np.clip(np.ceil(np.log2(max(count, 1))) + 2, LEAST_BITS, MOST_BITS))
    while True:
        meet = (1 - flip) ** bits
        tables = int(np.ceil(np.log(miss) / np.log1p(-meet))) if meet < 1 else 1
        if tables <= MOST_TABLES or bits == 1:
            return bits, tables
        bits -= 1


def learn_rotation(x: np.ndarray, seed: int = 3, turns: int = TURNS) -> np.ndarray:
    """An orthogonal matrix for the rows of x that brings them near to their signs."""
    d = x.shape[1]
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    turned = x @ axes
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(turns):
        u, _, vt = np.linalg.svd(np.sign(turned @ r).T @ turned)
        r = (u @ vt).T
    return axes @ r


def _directions(d: int, sample: np.ndarray | None, bits: int, n: int) -> np.ndarray:
    """n columns out of as many rotations as that takes.

    They are random where the sample has no such vectors, and from the second on where a
    table needs all components of one or more: learned ones would be alike.
    """
    made = []
    for seed in range(-(-n // d)):
        random = sample is None or (seed and d <= bits)
        made.append(np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0] if random else learn_rotation(sample, seed))
    return np.concatenate(made, axis=1)[:, :n]


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large numbers leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) for each number of components; without the rows that can't be compared."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    starts, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(starts), 0)
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        x = values[starts[rows][:, None] + np.arange(d)]
        usable = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if usable.any():
            yield rows[usable], _units(x[usable])


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


class Coder:
    """The learned directions: codes of `tables` keys, and a sketch, of any unit vectors."""

    def __init__(self, bits: int, tables: int, samples: dict[int, np.ndarray]):
        self.bits, self.tables = bits, tables
        self.columns = {d: _directions(d, x, bits, bits * tables + SKETCH) for d, x in samples.items()}

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x.shape[1]
        if d not in self.columns:
            self.columns[d] = _directions(d, None, self.bits, self.bits * self.tables + SKETCH)
        signs = x @ self.columns[d] >= 0
        keys = signs[:, : -SKETCH].reshape(len(x), self.tables, self.bits) @ (1 << np.arange(self.bits))
        return keys.astype(np.int32), np.packbits(signs[:, -SKETCH:], axis=1)


def fit_coder(rows: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> Coder:
    """From (id, label, v) of usable vectors: one pass that counts, one that takes the sample."""
    counts = rows.groupBy("label").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()
    share = min(1.0, sample / max(counts["all"] or 1, 1))
    taken = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).select("v").limit(sample).toArrow()
    samples: dict[int, list] = {}
    for _, x in _matrices(taken.column("v")):
        samples.setdefault(x.shape[1], []).append(x)
    return Coder(*plan(counts["most"] or 0, threshold), {d: np.concatenate(x) for d, x in samples.items()})


def encode(rows: DataFrame, coder: Coder) -> DataFrame:
    """(id, label, v) with d, digest (of the unit vector), keys and sketch; these are null where v can't be compared."""
    shared = rows.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, digest, keys, sketch = ([None] * n for _ in range(4))
            for at, x in _matrices(batch.column(2)):
                x += 0.0  # no negative zeros
                made, bits = shared.value(x)
                for i, row in enumerate(at):
                    size[row], keys[row], sketch[row] = x.shape[1], made[i], bits[i].tobytes()
                    digest[row] = hashlib.blake2b(x[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int32())), pa.array(sketch, pa.binary())],
                [*batch.schema.names, "d", "digest", "keys", "sketch"],
            )

    more = [StructField("d", IntegerType()), StructField("digest", BinaryType()), StructField("keys", ArrayType(IntegerType())), StructField("sketch", BinaryType())]
    return rows.select("id", "label", "v").mapInArrow(run, StructType([*(rows.schema[c] for c in ("id", "label", "v")), *more]))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the links (a, b) join: from each node to the least that it can reach."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != np.arange(len(ids)))
    return ids[moved], ids[least[moved]]


def _partners(bucket: np.ndarray, part: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The range of rows that each row is compared with; rows are sorted by bucket and part."""
    if a == b:
        return np.arange(1, len(bucket) + 1), np.searchsorted(bucket, bucket, side="right")
    first = int(np.searchsorted(part, b))  # a large bucket's two parts
    return np.full(len(part), first), np.where(part == a, len(part), first)


def _portions(lo: np.ndarray, hi: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (i, j) with lo[i] <= j < hi[i], about `most` at a time."""
    each = np.maximum(hi - lo, 0)
    upto = np.cumsum(each)
    at = 0
    while at < len(each):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most)))
        n = each[at:end]
        i = np.repeat(np.arange(at, end), n)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:end], n)
        at = end


def _near_sketches(table: pa.Table, a: int, b: int, most: int) -> pa.Table:
    """The rows of a block that have a partner within the Hamming distance `most`."""
    table = table.sort_by([("bucket", "ascending"), ("part", "ascending")])
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, -1)
    near = np.zeros(table.num_rows, bool)
    for i, j in _portions(*_partners(table.column("bucket").to_numpy(), table.column("part").to_numpy(), a, b), NUMBERS // 4):
        close = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= most
        near[i[close]] = near[j[close]] = True
    return table.filter(pa.array(near)).select(["row", "bucket", "t", "part", *_GROUP])


def _links(table: pa.Table, a: int, b: int, d: int, threshold: float) -> pa.Table:
    """(row, row, n) how many vectors each row of a block links with, and (row, other, 0) the links' forest."""
    table = table.sort_by([("bucket", "ascending"), ("part", "ascending")])
    rows, weight, t = (table.column(c).to_numpy() for c in ("row", "n", "t"))
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
    x = np.empty((len(rows), d))
    for at, units in _matrices(table.column("v")):
        x[at] = units
    lo, hi = _partners(table.column("bucket").to_numpy(), table.column("part").to_numpy(), a, b)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if len(rows) and table.column("place")[0].as_py() < 0:  # one large bucket: products of slabs
        for at in range(0, len(rows), 512):
            i, j = np.nonzero(x[at : at + 512] @ x.T >= threshold)
            i += at
            own = (lo[i] <= j) & (j < hi[i])
            found.append((i[own], j[own]))
    else:
        for i, j in _portions(lo, hi, max(NUMBERS // d, 1)):
            near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            found.append((i[near], j[near]))
    first = [(i, j) for i, j in found if len(i)]
    first = [(i[own], j[own]) for i, j in first for own in [(keys[i] == keys[j]).argmax(axis=1) == t[i]]]  # met in an earlier table: counted there
    i, j = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*first) if first else ((), ())))
    n = np.bincount(i, weight[j], len(rows)) + np.bincount(j, weight[i], len(rows))
    some = np.flatnonzero(n)
    p, q = _forest(rows[i], rows[j])
    return pa.table({
        "row": pa.array(np.concatenate([rows[some], p])), "other": pa.array(np.concatenate([rows[some], q])), "n": pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(p), np.int64)])),
    })


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, other, n) as `_links` gives them; vectors: (row, label, d, v, keys, sketch, n) with unique rows."""
    flip = np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi
    apart = int(np.ceil(SKETCH * flip + 4 * np.sqrt(SKETCH * flip * (1 - flip))))
    entries = vectors.select("row", "label", "d", F.posexplode("keys").alias("t", "key"))
    bucket = ["label", "d", "t", "key"]
    buckets = entries.groupBy(*bucket).agg(F.count("*").alias("held")).filter("held > 1")
    buckets = cut(buckets.withColumn("bucket", F.monotonically_increasing_id()))
    # Small buckets go to a block together; a large one has blocks of its own.
    blocks = max(1, -(-(buckets.filter(F.col("held") <= BLOCK).agg(F.sum("held")).first()[0] or 0) // TOGETHER))
    place = F.when(F.col("held") > BLOCK, -1 - F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(blocks)))
    members = cut(entries.join(buckets.withColumn("place", place), bucket).select("row", "d", "t", "bucket", "held", "place"))
    parted = dealt(members, F.ceil(F.col("held") / BLOCK), "row")
    sketched = parted.join(vectors.select("row", "sketch"), "row").select("row", "bucket", "t", "part", "sketch", *_GROUP)

    def sift(key: tuple, table: pa.Table) -> pa.Table:
        return _near_sketches(table, key[2].as_py(), key[3].as_py(), apart)

    near = cut(sketched.groupBy(*_GROUP).applyInArrow(sift, "row long, bucket long, t int, part int, d int, place long, block_a int, block_b int"))
    whole = near.join(vectors.select("row", "n", "keys", "v"), "row")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        return _links(table, key[2].as_py(), key[3].as_py(), key[0].as_py(), threshold)

    return whole.groupBy(*_GROUP).applyInArrow(compare, "row long, other long, n long")


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label)."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    vector = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")  # floats stay short in shuffles
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("label"), vector.alias("v"))
    comparable = F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = rows.withColumn("v", F.when(comparable, F.col("v")))
    coder = fit_coder(rows.filter(_usable(F.col("v"))), threshold)
    own = ["label", "d", "digest"]
    coded = encode(rows, coder)
    all_ = cut(coded.select("id", *own))
    size = all_.filter("digest is not null").distinct().groupBy(*own).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = coded.filter("digest is not null").groupBy(*own).agg(F.any_value("v").alias("v"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch"))
    vectors = cut(classes.join(size, own).withColumn("row", F.monotonically_increasing_id()))

    found = cut(vector_links(vectors, threshold))
    groups = components(found.filter("n = 0").select(F.col("row").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "row")
    linked = vectors.select("row", "least", "n", *own).join(found.groupBy("row").agg(F.sum("n").alias("links")), "row", "left").join(groups, "row", "left")
    linked = linked.withColumn("component", F.coalesce("component", "row"))
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    result = linked.join(names, "component").select(*own, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = all_.join(cut(result), own, "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))
