"""Running totals and quantiles against plain loops, on even and clustered values."""

import numpy as np
import pytest

from caseloom.operators.ranking import exact_quantiles, running_totals

RNG = np.random.default_rng(5)
SHAPES = {
    "even": RNG.random(3_000),
    "clustered": np.concatenate([0.5 + RNG.random(2_500) * 1e-12, RNG.random(500) * 1e6]),
    "few": RNG.integers(0, 4, 3_000).astype(float),
    "single": np.full(10, 3.0),
    "negative": -np.exp(RNG.normal(0, 20, 2_000)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_running_totals(spark, shape):
    values, counts = np.unique(SHAPES[shape], return_counts=True)
    table = spark.createDataFrame([(float(v), int(c), int(c) * 2) for v, c in zip(values, counts)], "v double, a long, b long")
    found = {r["v"]: r for r in running_totals(table, "v", ["a", "b"]).collect()}
    before = 0
    for v, c in zip(values, counts):
        assert (found[v]["a_before"], found[v]["b_before"]) == (before, 2 * before)
        before += int(c)
    assert {(r["a_all"], r["b_all"]) for r in found.values()} == {(before, 2 * before)}


@pytest.mark.parametrize("shape", SHAPES)
def test_quantiles(spark, shape):
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    rows = [(k, float(v)) for k in ("x", "y") for v in SHAPES[shape] * (1 if k == "x" else 2)] + [("x", None)]
    found = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "v", shares, "k").collect()}
    for key, factor in (("x", 1), ("y", 2)):
        assert found[key]["n"] == len(SHAPES[shape])
        np.testing.assert_allclose(found[key]["quantiles"], np.quantile(SHAPES[shape] * factor, shares), rtol=1e-12)


def test_no_window_over_the_whole_table(spark):
    """The shuffle that folds equal values is run once and reused."""
    table = spark.createDataFrame([("a", float(i)) for i in range(100)], "k string, v double")
    found = exact_quantiles(table, "v", [0.5], "k")
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().toString()
