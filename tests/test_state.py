"""Reachability on deep and branching graphs, values carried along hot keys, numbering and zipping without a window over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from codelake.operators import graph, state


def plain_reach(edges, roots, leaves=()):
    out = set()
    for r in roots:
        seen, todo = {r}, [r]
        while todo:
            x = todo.pop()
            new = {b for a, b in edges if a == x and x not in leaves} - seen
            seen |= new
            todo += new
        out |= {(r, x) for x in seen}
    return out


def rounds(monkeypatch, call):
    """What a call gives, and how many tables it wrote down."""
    made, own = [], graph._counted
    monkeypatch.setattr(graph, "_counted", lambda df: made.append(1) or own(df))
    out = {tuple(r) for r in call().collect()}
    return out, len(made)


def test_a_chain_of_2000_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW", 0)
    edges = spark.range(1999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found, written = rounds(monkeypatch, lambda: graph.reachable(edges, spark.createDataFrame([(0,), (1990,)], "root long")))
    assert found == {(0, i) for i in range(2000)} | {(1990, i) for i in range(1990, 2000)}
    assert written <= 2 + 2 * 14  # edges and roots, then two tables a round: under 15 rounds


@pytest.mark.parametrize("grown, few", [(8, 20_000), (8, 0), (0, 0)])
def test_reachable_on_graphs_with_cycles_and_branches(spark, monkeypatch, grown, few):
    monkeypatch.setattr(graph, "GROWN", grown)
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(5)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(i, i + 1) for i in range(50, 70)] + [(70, 55), (None, 3), (3, None)]
    roots, leaves = [0, 7, 50, 99], {rng.randrange(40) for _ in range(3)} | {60}
    frame = spark.createDataFrame(edges, "src int, dst int")
    root = spark.createDataFrame([(r,) for r in roots], "root int")
    known = [e for e in edges if None not in e]
    assert {tuple(r) for r in graph.reachable(frame, root).collect()} == plain_reach(known, roots)
    assert {tuple(r) for r in graph.reachable(frame, root, spark.createDataFrame([(x,) for x in leaves], "node int")).collect()} == plain_reach(known, roots, leaves)
    assert graph.reachable(frame.limit(0), root).count() == 4 and graph.reachable(frame, root.limit(0)).count() == 0


@pytest.fixture(scope="module")
def rows_of_a_hot_key():
    """Nine of ten rows belong to one key, which has values rarely; one key is null."""
    rng = random.Random(3)
    rows = [(("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None, "z"])), i, rng.choice([None] * 60 + ["x", "y"]), rng.choice([None, i])) for i in range(3000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("most", [10**6, 100])
def test_carried_values(spark, rows_of_a_hot_key, most):
    df = spark.createDataFrame(rows_of_a_hot_key, "k string, at int, v string, n int").repartition(5)
    last, want = {}, set()
    for k, at, v, n in sorted(rows_of_a_hot_key, key=lambda r: r[1]):
        before = last.get(k, (None, None))
        last[k] = (before[0] if v is None else v, before[1] if n is None else n)
        want.add((k, at, v, n, *last[k]))
    got = state.carried(df, {"seen": F.col("v"), "number": F.col("n")}, ["k"], ["at"], most)
    assert got.columns == ["k", "at", "v", "n", "seen", "number"] and {tuple(r) for r in got.collect()} == want


def test_a_hot_key_is_no_single_task(spark, rows_of_a_hot_key):
    df = spark.createDataFrame(rows_of_a_hot_key, "k string, at int, v string, n int")
    ranged = state._in_ranges(df, ["k", "at"])
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert state.carried(df.limit(0), {"seen": F.col("v")}, ["k"], ["at"], -1).collect() == []


def test_numbers_and_zips_without_a_window(spark):
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("x"))
    out, rows = state.numbered(df, ["x"])
    assert rows == n and out.filter("place <> x").isEmpty()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    out, _ = state.numbered(df, [F.desc("x")])
    assert out.filter(f"place <> {n - 1} - x").isEmpty()
    names = spark.createDataFrame([("c",), ("a",), ("b",), (None,)], "name string")
    values = spark.createDataFrame([(i,) for i in (40, 10, 30, 20)], "value int")
    assert sorted(map(tuple, state.zip_by_place(names, values, ["name"], ["value"]).collect())) == [(0, None, 10), (1, "a", 20), (2, "b", 30), (3, "c", 40)]
    with pytest.raises(ValueError, match="4 and of 3"):
        state.zip_by_place(names, values.limit(3), ["name"], ["value"])
    assert state.zip_by_place(names, values.limit(3), ["name"], ["value"], strict=False).count() == 3
    assert state.numbered(names.limit(0), ["name"])[0].count() == 0


def test_not_in_reads_its_values_once(spark):
    rows, values = spark.range(1000).toDF("a"), spark.range(500).select((F.col("id") % 7).alias("v"))
    out = state.not_in(rows, "a", values)
    assert len(out.collect()) == 993
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Range (0, 500") == 1, final
    assert sorted(r["a"] for r in state.not_in(rows.limit(9), "a", values.select(F.col("v").cast("int"))).collect()) == [7, 8]
