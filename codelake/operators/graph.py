"""Graphs given as edges (src, dst)."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that driver and executors share."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codelake-"))
    return df.checkpoint(eager=True)


#: Edges that every task may hold (a few MB); with no more, each task walks from its own roots.
FEW = 20_000
#: Walks are doubled while their number, if none were equal, stays under so many times the edges.
GROWN = 8


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint, and its rows as counted while it was written."""
    seen = Observation()
    return cut(df.observe(seen, F.count("*").alias("n"))), seen.get["n"]


def _doubled(ways: DataFrame, most: int) -> DataFrame | None:
    """Pairs two of the ways apart; None if there may be more than `most` of them before equal ones are dropped."""
    out = ways.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("o"))
    into = ways.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("i"))
    if (out.join(into, "node").agg(F.sum(F.col("o").cast("double") * F.col("i"))).first()[0] or 0) > most:
        return None
    further = ways.select(F.col("src").alias("dst"), F.col("dst").alias("end"))
    return ways.join(further, "dst").select("src", F.col("end").alias("dst")).distinct()


def _walked(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """What each root reaches over at most FEW edges, which go to every task; the roots are shared out."""
    after: dict[object, list] = {}
    for src, dst in edges.collect():
        after.setdefault(src, []).append(dst)
    shared = edges.sparkSession.sparkContext.broadcast(after)
    kind = roots.schema["root"].dataType

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for root in batch.column(0):
                seen = dict.fromkeys([root.as_py()])
                todo = list(seen)
                while todo:
                    new = [b for b in shared.value.get(todo.pop(), ()) if b not in seen]
                    seen.update(dict.fromkeys(new))
                    todo += new
                yield pa.RecordBatch.from_arrays([pa.array([root.as_py()] * len(seen), root.type), pa.array(seen, root.type)], ["root", "node"])

    return roots.select("root").distinct().mapInArrow(walk, StructType([StructField("root", kind), StructField("node", kind)]))


def reachable(edges: DataFrame, roots: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(root, node) for all nodes that a root of roots (root) reaches, itself included.

    Nodes of leaves (node) are reached but not followed. Few edges are walked by the
    tasks that hold the roots. Otherwise each round joins what the roots reach in
    under 2^k steps with the walks of exactly 2^k steps, then doubles these, so the
    rounds grow with the logarithm of the depth: a chain of n nodes stays n walks at
    every length. Where walks multiply instead (graphs that branch
    are not deep), they are no longer doubled, and each round follows only what the
    last one found, 2^k steps at a time. It ends when a round finds nothing, so
    cycles do too.
    """
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    if leaves is not None:
        edges = edges.join(leaves.select(F.col("node").alias("src")), "src", "left_anti")
    ways, n = _counted(edges)
    if n <= FEW:
        return _walked(ways, roots.select(F.col("root").cast(ways.schema["src"].dataType)))
    most = GROWN * n
    seen, held = _counted(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("round")).distinct())
    round_, doubling = 0, True
    while True:
        round_ += 1
        # While walks grow, all that is known goes further by the new length.
        start = seen if doubling else seen.filter(F.col("round") == round_ - 1)
        found = start.join(ways, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(round_).alias("round"))
        seen, now = _counted(seen.unionByName(found).groupBy("root", "node").agg(F.min("round").alias("round")))
        if now == held:
            return seen.select("root", "node")
        held = now
        if doubling:
            longer = _doubled(ways, most)
            doubling = longer is not None
            if doubling:
                ways, _ = _counted(longer)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges in and out, a loop once."""
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return edges.select(F.explode(ends).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
