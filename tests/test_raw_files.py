"""Reading raw quarterly files."""

import pytest
from pyspark.sql import functions as F

from caseloom.sources import proxies
from caseloom.sources.raw import load_quarters, read_file, read_quarter, read_table, write_raw
from caseloom.sources.sinks import write_cases, write_csv
from conftest import SMALL


@pytest.fixture()
def root(tmp_path):
    first = tmp_path / "2022q1" / "ASCII"
    first.mkdir(parents=True)
    (first / "DEMO22Q1.txt").write_text(
        "PrimaryID$AGE $sex$occr_country\n1$50$M$US\n2$60$F$NA\n3$70$F$DE$extra\n4$80\n5$90$M$FR$\n6$NA$\"U$K\"$FR\n",
        encoding="latin-1")
    (first / "DRUG22Q1.TXT").write_text(
        "primaryid$drug_seq$drugname$route$prod_ai\n1$1$B$oral$b\n1$2$A$null$a\n1$3$B$iv$b\n2$1$NA$$\n4$1$Café$oral$c\n",
        encoding="latin-1")
    (first / "REAC22Q1.txt").write_text("primaryid$pt\n1$rash\n1$nausea\n1$rash\n", encoding="latin-1")
    (first / "OUTC22Q1.txt").write_text("primaryid$outc_cod\n1$OT\n2$OT\n2$HO\n", encoding="latin-1")
    second = tmp_path / "2022q2"
    second.mkdir()
    (second / "DEMO22Q2.txt").write_text("primaryid$age$wt\n1$51$70.5\n7$20$60\n", encoding="latin-1")
    (second / "DRUG22Q2.txt").write_text("primaryid$drugname$route$prod_ai\n1$Z$z$z\n7$Q$q$q\n", encoding="latin-1")
    (tmp_path / "2022q3").mkdir()
    return str(tmp_path)


def test_rows_kept_and_names(spark, root):
    demo = read_file(spark, f"{root}/2022q1/ASCII/DEMO22Q1.txt")
    assert demo.columns == ["primaryid", "age", "sex", "occr_country", "row_order"]
    rows = {r["primaryid"]: (r["age"], r["sex"], r["occr_country"]) for r in demo.collect()}
    assert rows == {1: ("50", "M", "US"), 2: ("60", "F", "NA"), 4: ("80", None, None), 6: (None, "U$K", "FR")}
    assert demo.count() == 4
    for name in demo.columns:
        assert len(demo.select(name).collect()) == 4


def test_load(spark, root):
    with pytest.warns(UserWarning):
        cases = load_quarters(spark, root, ["2022q1", "2022q2", "2022q3", "2030q1", ""])
    rows = {r["primaryid"]: r for r in cases.collect()}
    assert set(rows) == {1, 2, 4, 6, 7}
    assert (rows[1]["drugname"], rows[1]["route"], rows[1]["reactions"], rows[1]["quarter"]) == ("B | A", "oral | iv", "rash | nausea", "2022q1")
    assert (rows[2]["drugname"], rows[2]["route"]) == ("", "")
    assert rows[4]["drugname"] == "Café" and rows[6]["drugname"] is None
    assert {k: r["serious"] for k, r in rows.items()} == {1: 0, 2: 1, 4: 0, 6: 0, 7: None}
    assert rows[1]["wt"] is None and rows[7]["wt"] == "60" and rows[1]["drug_seq"] == 3.0


def test_load_samples_exactly(spark, root):
    with pytest.warns(UserWarning):
        assert load_quarters(spark, root, ["2022q1", "2022q2"], sample_size=3).count() == 3


def test_nothing_to_load(spark, tmp_path):
    with pytest.warns(UserWarning):
        assert load_quarters(spark, str(tmp_path), ["2022q1"]).count() == 0


def test_missing_table_and_folder_layouts(spark, root):
    with pytest.warns(UserWarning):
        assert read_table(spark, f"{root}/2022q2", "OUTC") is None
        assert sorted(read_quarter(spark, f"{root}/2022q2", "2022q2")) == ["DEMO", "DRUG"]
    assert sorted(read_quarter(spark, f"{root}/2022q1", "2022q1")) == ["DEMO", "DRUG", "OUTC", "REAC"]


def test_order_survives_many_input_splits(spark, tmp_path):
    lines = "".join(f"{i % 50}$v{i}\n" for i in range(5_000))
    (tmp_path / "REAC.txt").write_text("primaryid$pt\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_file(spark, str(tmp_path / "REAC.txt"))
        assert rows.rdd.getNumPartitions() > 4
        ordered = [r["pt"] for r in rows.orderBy("row_order").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered == [f"v{i}" for i in range(5_000)]


def test_round_trip_of_proxies(spark, tmp_path):
    outc = proxies.outc(spark, SMALL)
    write_raw(outc.where("quarter = '2022q1'"), str(tmp_path), "OUTC22Q1")
    back = read_table(spark, str(tmp_path), "OUTC")
    expected = outc.where("quarter = '2022q1'").select("primaryid", "outc_cod")
    assert back.select("primaryid", "outc_cod").exceptAll(expected).isEmpty()
    assert back.count() == expected.count()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2022q1"), (2, "2022q2")], "primaryid long, quarter string")
    write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    write_cases(rows, str(tmp_path / "cases"))
    back = spark.read.parquet(str(tmp_path / "cases")).where(F.col("quarter") == "2022q1")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(quarter" in back._jdf.queryExecution().executedPlan().toString()
