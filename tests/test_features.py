"""Fitted preprocessing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.config import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES
from caseloom.functions.numbers import to_number
from caseloom.operators import features
from caseloom.operators.features import category_map, engineered_flags, fit_features, load_features, numbered_by_range


def values(df):
    return {r["primaryid"]: tuple(r[f] for f in FEATURES) for r in df.collect()}


def test_shape_and_order(two_reports):
    fitted = fit_features(two_reports)
    table = fitted.transform(two_reports)
    assert table.columns == ["primaryid", "serious", *FEATURES]
    assert table.count() == 2 and fitted.n_features == 16
    assert set(dict(table.dtypes)[f] for f in FEATURES) == {"double"}


def test_scaling_uses_the_population_deviation(two_reports):
    row = fit_features(two_reports).transform(two_reports).where("primaryid = 1").first()
    assert row["age"] == pytest.approx(1.0) and row["wt"] == pytest.approx(1.0) and row["dur"] == pytest.approx(1.0)


def test_median_fills_and_constants_stay(spark):
    rows = spark.createDataFrame([(1, 10.0, 5), (2, None, 5), (3, 40.0, 5), (4, 20.0, 5)], "primaryid long, age double, wt int")
    numeric = fit_features(rows).numeric
    filled = np.array([10.0, 20.0, 40.0, 20.0])
    assert numeric["age"] == pytest.approx((20.0, filled.mean(), filled.std()))
    assert numeric["wt"] == (5.0, 5.0, 1.0)
    assert numeric["dur"] == (0.0, 0.0, 1.0)  # no such column


def test_only_unseen_values_fall_back(spark, two_reports):
    fitted = fit_features(two_reports)
    other = two_reports.withColumn("sex", F.when(F.col("primaryid") == 1, "X").otherwise(F.col("sex")))
    codes = {r["primaryid"]: r["code_sex"] for r in fitted.encoded(other).collect()}
    assert codes == {1: 0, 2: 0}  # X is new, F stays F
    codes = {r["primaryid"]: r["code_sex"] for r in fitted.encoded(two_reports).collect()}
    assert codes == {1: 1, 2: 0}


def test_unseen_takes_the_unknown_code_if_there_is_one(spark):
    fit = spark.createDataFrame([(1, "A"), (2, None), (3, "Z")], "primaryid long, sex string")
    new = spark.createDataFrame([(1, "Q"), (2, None), (3, "Z")], "primaryid long, sex string")
    assert {r["primaryid"]: r["code_sex"] for r in fit_features(fit).encoded(new).collect()} == {1: 1, 2: 1, 3: 2}


def test_missing_columns(spark):
    rows = spark.range(3).withColumnRenamed("id", "primaryid")
    assert set(values(fit_features(rows).transform(rows)).values()) == {(0.0,) * 16}


def test_many_categories(spark):
    rows = spark.range(3_000).select(F.col("id").alias("primaryid"), F.concat(F.lit("r"), F.col("id") % 700).alias("route"),
                                     F.when(F.col("id") % 3 == 0, "US").otherwise(F.concat(F.lit("c"), F.col("id"))).alias("occr_country"),
                                     F.when(F.col("id") % 5 > 0, "M").alias("sex"))
    fitted = fit_features(rows)
    routes = {v: i for i, v in enumerate(sorted({f"r{i % 700}" for i in range(3_000)}))}
    countries = {v: i for i, v in enumerate(sorted({"US"} | {f"c{i}" for i in range(3_000) if i % 3}))}
    got = {r["primaryid"]: (r["code_route"], r["code_occr_country"], r["code_sex"]) for r in fitted.encoded(rows).collect()}
    assert got == {i: (routes[f"r{i % 700}"], countries["US" if i % 3 == 0 else f"c{i}"], 0 if i % 5 else 1) for i in range(3_000)}
    assert {tuple(r) for r in fitted.categories.collect()} == {tuple(r) for r in category_map(rows).collect()}


def test_numbering_by_range(spark):
    table = spark.createDataFrame([("f", f"v{i:04d}") for i in range(900)] + [("g", "only")], "feature string, value string")
    codes = {(r["feature"], r["value"]): r["code"] for r in numbered_by_range(table).collect()}
    assert codes == {("f", f"v{i:04d}"): i for i in range(900)} | {("g", "only"): 0}


def test_save_load(spark, two_reports, tmp_path):
    fitted = fit_features(two_reports)
    fitted.save(f"{tmp_path}/fitted")
    loaded = load_features(spark, f"{tmp_path}/fitted")
    assert loaded.n_features == fitted.n_features and loaded.numeric == fitted.numeric
    assert values(loaded.transform(two_reports)) == values(fitted.transform(two_reports))


def test_flags(spark):
    rows = spark.createDataFrame([(66, "6", "501", "91"), (17, "5", "500", "90"), (None, None, "x", None)],
                                 "age int, drug_seq string, dose_amt string, dur string")
    flags = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in engineered_flags(rows).items()]).collect()]
    assert flags == [(1, 0, 1, 1, 1), (0, 1, 0, 0, 0), (0, 0, 0, 0, 0)]


def test_flags_without_columns(spark):
    rows = spark.range(1)
    assert tuple(rows.select(*[c.alias(n) for n, c in engineered_flags(rows).items()]).first()) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("text, number", [("12", 12.0), (" 1.5 ", 1.5), ("-2e3", -2000.0), (".5", 0.5), ("5.", 5.0), ("1d", None),
                                          ("1f", None), ("", None), ("NA", None), ("inf", None), ("NaN", None), ("1,5", None), (None, None)])
def test_to_number(spark, text, number):
    rows = spark.createDataFrame([(text,)], "x string")
    assert rows.select(to_number(rows, "x")).first()[0] == number


def test_to_number_of_doubles(spark):
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (2.0,)], "x double")
    assert [r[0] for r in rows.select(to_number(rows, "x")).collect()] == [None, None, 2.0]


def test_layout_does_not_matter(spark, two_reports):
    fitted = fit_features(two_reports.repartition(7))
    assert fitted.numeric == fit_features(two_reports.coalesce(1)).numeric
    assert len(CATEGORICAL_FEATURES + NUMERIC_FEATURES) == 11


def test_codes_whatever_the_number_of_values(spark, monkeypatch):
    """Looked up in the row, by one join, or by one join for each feature: the same codes."""
    rows = [(i, "MF"[i % 2], None if i % 7 == 0 else f"C{i % 11}", f"r{i}", "x|y"[: i % 4]) for i in range(300)] + [(None, "M", "C1", "r1", "")]
    cases = spark.createDataFrame(rows, "primaryid long, sex string, occr_country string, route string, other string")
    fitted = features.fit_features(cases.where("primaryid % 3 > 0"))
    looked_up = fitted.encoded(cases)
    assert "Join" not in looked_up._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0].split("scalar-subquery")[0]
    monkeypatch.setattr(features, "LOOKUP_VALUES", 0)
    joined = fitted.encoded(cases)
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    each = fitted.encoded(cases.withColumnRenamed("primaryid", "key")).withColumnRenamed("key", "primaryid")
    want = sorted(map(repr, each.collect()))
    assert sorted(map(repr, looked_up.collect())) == sorted(map(repr, joined.collect())) == want
    assert looked_up.columns == joined.columns == each.columns


def test_only_features_of_many_values_are_joined(spark, monkeypatch):
    """Codes of one feature with many values take one join, in which a case is one row; the others are looked up."""
    rows = [(i, "MF"[i % 2], f"C{i % 3}", f"r{i % 50}") for i in range(200)]
    cases = spark.createDataFrame(rows, "primaryid long, sex string, occr_country string, route string")
    fitted = features.fit_features(cases.where("primaryid % 50 < 40"))
    want = sorted(map(repr, fitted.encoded(cases).collect()))
    monkeypatch.setattr(features, "LOOKUP_VALUES", 20)
    joined = fitted.encoded(cases)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("scalar-subquery")[0]
    assert sorted(map(repr, joined.collect())) == want
