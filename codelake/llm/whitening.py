"""Operator 12: principal components and whitening by a tree of QR factors (TSQR).

Every entry c becomes the long x = floor(1024 * c) + 100000. The sums S of x over all
n vectors are exact (as two halves of each number, added up as longs, then put
together without bounds), so the centred entry x - S/n is right to the last bit
although the offset is large: whole numbers are subtracted first, the rest of S/n
after that.

Each task folds its centred rows, batch by batch, into one upper triangle R (QR of
the last R and the next batch). Triangles are merged FAN at a time by further QRs
until one is left, which holds d * d numbers for d dimensions, however many vectors
there are. Its singular values s and right vectors are those of the whole centred
table: e = s^2 / n are the eigenvalues of the covariance, which is never formed, and
no precision is lost by squaring. Then every vector is projected once; the covariance
of what came out is compared with the identity.

Vectors that are null or hold null or non-finite entries are dropped, and so are those
with an entry of 2^43 or more, whose x no longer fits the arithmetic. Of vectors of
several lengths only those of the commonest (of equally common ones the longest) are
kept, and vectors without entries never. Repeated rows count and are returned each; a
null vec_id stays null. Components whose singular value is under RANK of the largest
have no direction of their own: they are left out, so that n equal vectors, a single
one, or an empty table give no rows. Equal eigenvalues leave their components' order
open. A vector's deviation that exceeds a long is null. Columns other than vec_id and
embedding are left behind, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

SCALE, OFFSET = 1024.0, 100_000
#: Components returned; how many triangles are merged at once; the least singular value as a share of the largest.
COMPONENTS, FAN, RANK = 8, 8, 1e-12
_LARGEST = float(1 << 43)
#: Numbers are summed in halves of so many bits.
_LOW = 26


def usable(v: Column) -> Column:
    """Neither null nor empty, and all entries finite and in range."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < _LARGEST), F.lit(False)))


def numbers(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch, all of one length, as whole numbers x, one row each."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * values) + OFFSET).astype(np.int64).reshape(len(column), -1)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square R of rows = QR; rows of zeros where there are fewer rows than columns."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((d - len(r), d))]) if len(r) < d else r


@dataclass
class Centre:
    """n vectors whose mean is whole + rest / n in each dimension, 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sums of (n * x - S)^2; longs that wrap around come out right where the sum itself fits one."""
        about = ((self.n * self.centred(x)) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            far = self.n * (x - self.whole) - self.rest
            exact = (far * far).sum(axis=1)
        return pa.array(exact, pa.int64(), mask=about >= 9.2e18)


@dataclass
class Whitening:
    """What `fit` found: where the centre is, components as columns, their eigenvalues, and the trace of the covariance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ (self.components / np.sqrt(self.eigenvalues))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, n, high, low) of each length d in a task."""
    held: dict[int, list] = {}
    for batch in batches:
        sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            x = numbers(batch.column(0).filter(pa.array(sizes == d)))
            own = held.setdefault(int(d), [0, np.zeros(d, np.int64), np.zeros(d, np.int64)])
            own[0] += len(x)
            own[1] += (x >> _LOW).sum(axis=0)
            own[2] += (x & ((1 << _LOW) - 1)).sum(axis=0)
    if held:
        n, high, low = zip(*held.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.int32()), pa.array(n, pa.int64()), pa.array(map(list, high), pa.list_(pa.int64())), pa.array(map(list, low), pa.list_(pa.int64()))], ["d", "n", "high", "low"]
        )


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): the usable rows, entries as doubles."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(usable(F.col("v")))


def centre_of(vectors: DataFrame) -> Centre | None:
    """One pass over the vectors, and a row for each dimension to the driver."""
    parts = cut(vectors.select("v").mapInArrow(_sums, "d int, n long, high array<long>, low array<long>"))
    most = parts.groupBy("d").agg(F.sum("n").alias("n")).agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    if most is None:
        return None
    by_place = parts.filter(F.col("d") == most["d"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("j", "s"))
    sums = by_place.groupBy("j").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).orderBy("j").collect()
    return Centre.of(most["n"], [(s["high"] << _LOW) + s["low"] for s in sums])


def triangles(vectors: DataFrame, centre: Centre) -> DataFrame:
    """(node, r): one triangle, row by row, of each task that has vectors; vectors: (v) of the centre's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = centre.centred(numbers(batch.column(0)))
                r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["node", "r"])

    return vectors.mapInArrow(run, "node long, r array<double>")


def merged(parts: DataFrame, d: int) -> np.ndarray:
    """One triangle of all: groups of FAN neighbours are merged until one is left."""
    parts = cut(parts)
    left = (parts.agg(F.max("node")).first()[0] or 0) + 1

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        r = triangle(table.column("r").combine_chunks().flatten().to_numpy().reshape(-1, d))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    while left > 1:
        parts = parts.groupBy(F.floor(F.col("node") / FAN).alias("above")).applyInArrow(merge, "node long, r array<double>")
        left = -(-left // FAN)
    return np.array(parts.first()["r"]).reshape(d, d)


def fit(vectors: DataFrame) -> Whitening | None:
    """Centre and components of all vectors (vec_id, v); None where there are none."""
    centre = centre_of(vectors)
    if centre is None:
        return None
    d = len(centre.whole)
    r = merged(triangles(vectors.filter(F.size("v") == d).select("v"), centre), d)
    s, right = np.linalg.svd(r)[1:]
    kept = min(COMPONENTS, int((s > RANK * s[0]).sum())) if s[0] > 0 else 0
    components = right[:kept].T
    # Of either sign the one whose largest entry is positive.
    signs = np.sign(components[np.abs(components).argmax(axis=0), np.arange(kept)]) if kept else np.ones(0)
    return Whitening(centre, components * signs, s[:kept] ** 2 / centre.n, float((s**2).sum() / centre.n))


def project(vectors: DataFrame, found: Whitening) -> DataFrame:
    """(vec_id, deviation, z): each vector's whitened numbers."""
    shared = vectors.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = numbers(batch.column(1))
                z = shared.value(x)
                width = pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), shared.value.centre.deviations(x), pa.ListArray.from_arrays(width, pa.array(z.ravel()))], ["vec_id", "deviation", "z"])

    return vectors.filter(F.size("v") == len(found.centre.whole)).mapInArrow(run, "vec_id long, deviation long, z array<double>")


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """The largest entry, without its sign, of the covariance of z (centred as it is) minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            z = batch.column(0).flatten().to_numpy().reshape(-1, k)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["at", "total"])

    cells = projected.select("z").mapInArrow(run, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    return max(abs(c["total"] / n - (c["at"] // k == c["at"] % k)) for c in cells)


def whiten(embeddings: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    vectors = vectors_of(embeddings)
    found = fit(vectors)
    if found is None or not len(found.eigenvalues):
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return embeddings.sparkSession.createDataFrame([], empty)
    projected = cut(project(vectors, found))
    error = identity_error(projected, found.centre.n, len(found.eigenvalues))
    shares = F.array(*(F.lit(float(e / found.trace)) for e in found.eigenvalues))
    rows = projected.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.centre.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
