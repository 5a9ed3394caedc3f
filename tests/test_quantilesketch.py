"""Quantiles of sketches against sorted values."""

import math
import random

import pytest

from caseloom.operators import features, quantilesketch as qs

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def exact(values, share):
    return sorted(values)[max(1, math.ceil(share * len(values))) - 1]


@pytest.mark.parametrize("error", [0.1, 0.01, 0.001])
def test_error_however_the_parts_are_cut(spark, error):
    rng = random.Random(7)
    values = [rng.choice([-1, 1]) * math.exp(rng.uniform(-12, 12)) for _ in range(2000)] + [0.0] * 300 + [5.0] * 400 + [1e300, -1e-300]
    rows = [(rng.randrange(4), "ab"[rng.randrange(2)], v) for v in values] + [(0, "a", None), (1, "c", None)]
    df = spark.createDataFrame(rows, "part int, g string, v double")
    parts = [qs.sketch(df.where(f"part = {i}"), "v", error, ["g"]) for i in range(4)]
    whole = qs.quantiles(qs.merge(parts, ["g"]), SHARES, error, ["g"]).collect()
    at_once = qs.quantiles(qs.sketch(df, "v", error, ["g"]), SHARES, error, ["g"]).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, at_once)) and {r.g for r in whole} == {"a", "b"}
    for row in whole:
        own = [v for _, g, v in rows if g == row.g and v is not None]
        assert row.n == len(own)
        for share, found in zip(SHARES, row.quantiles):
            want = exact(own, share)
            assert abs(found - want) <= abs(want) * error * (1 + 1e-9)


def test_counts_as_weights(spark):
    df = spark.createDataFrame([(1.0, 5), (10.0, 1), (100.0, 4)], "v double, n long")
    row = qs.quantiles(qs.sketch(df, "v", 0.01, count="n"), [0.5, 0.6, 0.61]).first()
    assert row.n == 10 and [round(q) for q in row.quantiles] == [1, 10, round(row.quantiles[2])]
    assert abs(row.quantiles[2] - 100) <= 1


def test_nothing_and_bad_errors(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert qs.quantiles(qs.sketch(none, "v"), [0.5]).collect() == []
    for error in (0, 1, -0.1):
        with pytest.raises(ValueError):
            qs.sketch(none, "v", error)


def test_numeric_stats_from_sketches(spark, two_reports):
    near = {r.feature: r for r in features.numeric_stats(two_reports, error=0.01).collect()}
    assert abs(near["age"].median - 48) <= 0.48
