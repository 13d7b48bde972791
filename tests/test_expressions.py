"""The native evaluator against the plain one."""

import random

import pytest
from pyspark.sql import functions as F

from codelake import build
from codelake.functions import constants


def made(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([str(rng.randrange(300)), hex(rng.randrange(70_000)), "0", str(rng.randrange(1, 9))])
    if kind < 0.4:
        return rng.choice("-+~") + rng.choice(["", " "]) + made(rng, depth - 1)
    if kind < 0.55:
        return f"({made(rng, depth - 1)})"
    if kind < 0.65:
        return f"{rng.choice(list(constants.SLOT_SHIFTS))}({made(rng, depth - 1)})"
    op = rng.choice(["|", "^", "&", "<<", ">>", "+", "-", "*", "/", "%", "//"])
    right = str(rng.randrange(12)) if op in ("<<", ">>") else made(rng, depth - 1)
    return f"{made(rng, depth - 1)}{rng.choice(['', ' '])}{op} {right}"


ODD = ["", " ", "1 2", "(1", "1)", "()", "1 +", "* 2", "- - 3", "~-+5", "1.5", "1e5", "010", "00", "0x", "0x1G", "5u", "A", "A(1)", "BPARAM1()", "BPARAM1", "BPARAM9(1)", "BPARAM2 (3) | BPARAM4(0x1FF)", "2 ** 3", "(1)(2)", "1,2", "'a'", "7 / 0", "7 % 0", "1 << -1", "1 << 70", "0 << 70", "-1 >> 70", "-7 / 2", "-7 % 3", "7 % -3", "-8 / -3", "1 << 62", "1 << 63", "9223372036854775807 + 1", "9223372036854775808", "0xFFFFFFFF", "0xFFFFFFFFFFFFFFFF", "1 - 2 - 3", "2 + 3 * 4 << 1 & 0xF ^ 3 | 16", " 42 ", "True", "1 if 1 else 2"]


def test_the_native_evaluator_equals_the_plain_one(spark):
    rng = random.Random(11)
    texts = ODD + [made(rng, 4) for _ in range(600)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r["i"]: r["v"] for r in df.select("i", constants.int_value(F.col("x")).alias("v")).collect()}
    small = lambda t: all(abs(v) < 2**63 for v in [constants.evaluate(t) or 0])
    wrong = [(t, got[i], constants.evaluate(t)) for i, t in enumerate(texts) if got[i] != constants.evaluate(t) and small(t)]
    # What differs may only have left the longs on the way.
    assert all(v is None for _, v, _ in wrong) and len(wrong) <= 0.02 * len(texts), wrong[:5]
    assert sum(v is not None for v in got.values()) > 450
    assert spark.createDataFrame([(None,)], "x string").select(constants.int_value(F.col("x"))).first()[0] is None


@pytest.mark.parametrize("name", ["object", "macro_object", "special_object"])
def test_placements_need_no_python(tables, spark, tmp_path, name):
    from test_tree import FILES

    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    tree = build.Tree(spark, str(tmp_path))
    plan = build.BUILDERS[name](tree)._jdf.queryExecution().executedPlan().toString()
    assert name == "special_object" or "Python" not in plan and "Arrow" not in plan
    assert plan.count("ArrowEvalPython") <= 1  # special objects read their enum's members by one
