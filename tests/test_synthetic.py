"""The synthetic case table."""

import pytest
from pyspark.sql import functions as F

from caseloom.sources.synthetic import demo_cases

COLUMNS = ["primaryid", "age", "sex", "wt", "occr_country", "drug_seq", "dose_amt", "dose_freq", "dur", "dechal",
           "rechal", "drugname", "route", "prod_ai", "reactions", "quarter", "serious"]


@pytest.fixture(scope="module")
def demo(spark):
    return demo_cases(spark, 20_000).cache()


def test_columns_and_ranges(demo):
    assert demo.columns == COLUMNS and demo.count() == 20_000
    row = demo.agg(*[F.min(c).alias(f"{c}_min") for c in ("age", "wt", "drug_seq", "dur")],
                   *[F.max(c).alias(f"{c}_max") for c in ("age", "wt", "drug_seq", "dur")]).first()
    assert (row["age_min"], row["age_max"], row["drug_seq_min"], row["drug_seq_max"]) == (1, 100, 1, 9)
    assert row["wt_min"] >= 30 and row["wt_max"] <= 200 and (row["dur_min"], row["dur_max"]) == (1, 364)


def test_shares(demo):
    sex = {r["sex"]: r["count"] / 20_000 for r in demo.groupBy("sex").count().collect()}
    assert sex["M"] == pytest.approx(0.45, abs=0.02) and sex["UNK"] == pytest.approx(0.10, abs=0.02)
    row = demo.agg(F.avg("age"), F.stddev("wt"), F.avg("serious")).first()
    assert row[0] == pytest.approx(54.5, abs=0.7) and row[1] == pytest.approx(19.8, abs=0.7)
    assert 0.3 < row[2] < 0.7


def test_reactions_are_distinct(demo):
    parts = demo.select(F.split("reactions", " \\| ").alias("p"))
    assert parts.where((F.size("p") != F.size(F.array_distinct("p"))) | ~F.size("p").between(1, 3)).isEmpty()


def test_same_rows_on_every_layout_and_seeds_differ(spark, tmp_path):
    first = demo_cases(spark, 500, save_to=str(tmp_path / "demo")).collect()
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        assert sorted(demo_cases(spark, 500).collect()) == sorted(first)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert sorted(demo_cases(spark, 500, seed=1).collect()) != sorted(first)
    assert spark.read.option("header", True).csv(str(tmp_path / "demo")).count() == 500
