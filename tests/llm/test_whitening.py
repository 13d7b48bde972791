"""Whitening against numpy's eigenvectors of the covariance, and odd rows."""

import math

import numpy as np
import pandas as pd
import pytest

from codelake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def plain(vectors):
    """The contract, from the covariance of exact integers."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    far = n * x - sums
    centred = (far / n).astype(float)
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, (far**2).sum(axis=1), centred, e[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("d, rows, parts", [(12, 300, 1), (12, 300, 19), (3, 40, 5), (70, 40, 6)])
def test_against_eigenvectors(spark, d, rows, parts):
    rng = np.random.default_rng(d)
    v = (rng.normal(size=(rows, d)) * np.linspace(3, 0.2, d) + rng.normal(size=d)).astype(np.float32)
    df = spark.createDataFrame([(i, a.tolist(), None, "x") for i, a in enumerate(v)], SCHEMA).repartition(parts)
    got = pd.DataFrame([r.asDict() for r in whitening.whiten(df).collect()]).sort_values(["component", "vec_id"])
    n, deviation, centred, e, w = plain(v)
    k = min(8, d)
    assert len(got) == rows * k and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    for c in range(k):
        own = got[got["component"] == c + 1]
        z = centred @ w[:, c] / np.sqrt(e[c])
        z *= np.sign(z @ own["whitened"].to_numpy())
        assert np.allclose(own["whitened"], z, atol=1e-8) and own["deviation"].tolist() == deviation.tolist()
        assert np.allclose(own["explained"], e[c] / e.sum(), rtol=1e-9)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 1, "x"), (1, [1.0, 2.0], 1, "x"), (None, [0.5, -1.0], None, None), (2, None, 1, "x"), (3, [float("nan"), 1.0], 1, "x"), (4, [1.0, None], 1, "x"), (5, [float("inf"), 1.0], 1, "x"), (6, [], 1, "x"), (7, [1.0, 2.0, 3.0], 1, "x"), (8, [1e30, 0.0], 1, "x"), (9, [0.0, 0.0], 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = whitening.whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((i, c) for i in ("1", "1", "9", "None") for c in (1, 2)) and {r["n"] for r in got} == {4}
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.filter("vec_id = 1")).collect() == [] and whitening.whiten(df.filter("vec_id = 2")).collect() == []


def test_flat_directions_are_left_out(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0, float(i % 3)], 0, "") for i in range(50)], SCHEMA)
    got = whitening.whiten(df).collect()
    assert {r["component"] for r in got} == {1, 2} and abs(sum(r["explained"] for r in got) / 50 - 1) < 1e-12


def test_far_numbers_stay_exact(spark):
    v = [[4e9, 1.0], [-4e9, 2.0], [1.5, 3.0]]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame([(i, a, 0, "") for i, a in enumerate(v)], SCHEMA.replace("float", "double"))).filter("component = 1").collect()}
    want = plain(v)[1]
    assert got == {i: int(x) if x < 1 << 63 else None for i, x in enumerate(want)} and None in got.values() and got[2] is not None
