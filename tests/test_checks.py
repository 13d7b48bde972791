"""Fingerprints, coverage, claims between relations, key audits and invariants, each with planted faults."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codelake import build
from codelake.operators import checks, keys
from codelake.plans import invariants
from test_tree import rows


def test_fingerprints_don_t_depend_on_order_but_on_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, None, 0.5), (3, "c", 1.0)], "i int, s string, x double")
    assert checks.same_rows(df, df.orderBy(F.desc("i")).repartition(3)) and checks.same_rows(df, df.toDF("p", "q", "r"))
    assert not checks.same_rows(df, df.distinct()) and not checks.same_rows(df, df.withColumn("s", F.upper("s"))) and not checks.same_rows(df, df.drop("x"))
    null = lambda a, b: spark.createDataFrame([(a, b)], "a int, b int")
    assert not checks.same_rows(null(None, 1), null(1, None)) and not checks.same_rows(null(None, 1), null(0, 1))
    assert checks.same_rows(df.limit(0), df.filter("i > 9"))
    read, seen = checks.observed(df)
    read.collect()
    assert seen.get["rows"] == 4 and [seen.get[k] for k in ("rows", "sum_1", "sum_2")] == list(df.agg(*checks.fingerprint(df.columns)).first())


def test_coverage_is_a_histogram_of_parts(spark):
    parts = {"even": F.col("id") % 2 == 0, "three": F.col("id") % 3 == 0, "null": F.lit(None).cast("boolean")}
    got = {tuple(r["parts"]): r["n"] for r in checks.coverage(spark.range(100), parts).collect()}
    assert got == Counter(tuple(k for k, m in (("even", 2), ("three", 3)) if i % m == 0) for i in range(100))


@pytest.mark.parametrize("examples", [False, True])
def test_claims_against_counters(spark, examples):
    rng = random.Random(7)
    some = {n: [(rng.randrange(9), rng.choice("xy")) for _ in range(rng.randrange(25))] for n in "abcd"}
    some["whole"] = some["a"] + some["b"]
    some["empty"] = []
    frames = {n: spark.createDataFrame(r, f"{n}_i int, {n}_s string") for n, r in some.items()}
    n = {k: Counter(v) for k, v in some.items()}
    rows_ = set().union(*n.values())
    claims = {
        checks.subset("c", "d"): sum(n["c"][r] > 0 == n["d"][r] for r in rows_), checks.subset("a", "whole"): 0, checks.subset("empty", "a"): 0,
        checks.disjoint("b", "c", "d"): sum((n["b"][r] > 0) + (n["c"][r] > 0) + (n["d"][r] > 0) > 1 for r in rows_),
        checks.union_of("whole", "a", "b"): 0, checks.union_of("whole", "a", "c"): sum((n["whole"][r] > 0) != (n["a"][r] + n["c"][r] > 0) for r in rows_),
        checks.partition("whole", "a", "b"): sum(n["a"][r] > 0 and n["b"][r] > 0 for r in rows_),
    }
    got = checks.check(frames, list(claims), examples).collect()
    assert {r["claim"]: r["broken"] for r in got} == {c.name: k for c, k in claims.items()} and any(claims.values())
    if examples:
        assert all((r["example"] is not None) == (r["broken"] > 0) for r in got)
    plan = checks.check(frames, list(claims))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1  # however many claims there are


def test_dangling_keys(spark):
    tables = {
        "city": spark.createDataFrame([(1, 7, 3), (2, 7, None), (3, 8, 99), (4, None, 1), (5, 9, 99)], "id int, land long, twin int"),
        "land": spark.createDataFrame([(7, "x"), (7, "y"), (8, None), (None, "z")], "id int, name string"), "none": spark.createDataFrame([], "id int, land int"),
    }
    want = [("city", "land", "land", "id"), ("city", "twin", "city", "id"), ("none", "land", "land", "id"), ("land", "id", "none", "id"), ("city", "id", "city", "twin")]
    got = {r["key"]: (r["dangling"], r["different"]) for r in keys.dangling(tables, want).collect()}
    assert got == {"city.land": (1, 1), "city.twin": (2, 1), "none.land": (0, 0), "land.id": (3, 2), "city.id": (3, 3)}
    plan = keys.dangling(tables, want)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_key_audit_of_a_tree_equals_each_key_alone(tables):
    got = {r["key"]: r["dangling"] for r in build.audit(tables).collect()}
    sample = [k for k in build.FOREIGN_KEYS if k[0] in ("object", "warp", "macro_preset", "mario_action_data_transition")]
    for child, column, parent, key in sample:
        assert got[f"{child}.{column}"] == sum(r["count"] for r in build.orphans(tables, child, column, parent, key).collect())
    assert len(got) == len(build.FOREIGN_KEYS)


def test_invariants_hold_and_faults_show(spark, tables):
    t = tables | build.views(tables)
    found = {r["claim"]: r["broken"] for r in invariants.report(t).collect()}
    overlap = found.pop("all = literal + data")
    both = set(rows(t["mario_transition"], "action_name", "to_action")) & set(rows(t["mario_action_data_transition"], "action_name", "to_action"))
    assert overlap == len(both) and not any(found.values()) and len(found) == 13
    calls = rows(invariants.call_space(t), "n")
    assert sum(n for (n,) in calls) == t["behavior_call"].count()
    # A call lost from the residue, a target lost, a transition too many, a refuted one alive.
    broken = dict(t)
    broken["behavior_call_unclassified"] = t["behavior_call_unclassified"].withColumn("n", F.col("n") - 1)
    broken["behavior_calls_sound"] = t["behavior_calls_sound"].withColumn("sound", F.lit(None).cast("string"))
    broken["mario_all_transitions"] = t["mario_all_transitions"].union(spark.createDataFrame([("ACT_X", "ACT_Y")], "a string, b string"))
    broken["mario_transition"] = t["mario_transition"].union(t["mario_transition_refuted"].select("action_name", "to_action"))
    found = {r["claim"]: r["broken"] for r in invariants.report(broken).collect()}
    assert found["the residue is listed"] == t["behavior_call_unclassified"].count() and found["targets of sound"] == t["behavior_calls_sound"].count() > 0
    assert found["all = literal or data"] >= 1 and found["literal apart from refuted"] == t["mario_transition_refuted"].select("action_name", "to_action").distinct().count() > 0
