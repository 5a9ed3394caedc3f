"""Roll-ups, joins, deduplication, sampling."""

from pyspark.sql import functions as F

from caseloom.operators import cases
from caseloom.operators.cases import (CaseTables, assemble, distinct_values, first_drug, joined_values, keep_first,
                                      union_quarters)
from caseloom.operators.ranking import sample_exact
from caseloom.operators.splits import split, stratified_folds, train_flag

DRUG = "quarter string, primaryid long, row_order long, drugname string, route string, prod_ai string"


def demo(spark, rows):
    return spark.createDataFrame(rows, "quarter string, primaryid long, row_order long, age int")


def test_order_of_first_appearance(spark):
    rows = [("q", 1, 3, "b", "x", None), ("q", 1, 1, "c", None, None), ("q", 1, 2, "b", "y", None),
            ("q", 1, 4, "c", "x", None), ("q", 2, 1, None, None, None), ("q", None, 1, "z", "z", "z")]
    drug = spark.createDataFrame(rows, DRUG)
    expected = {1: ("c | b", "y | x", ""), 2: ("", "", "")}
    for layout in (drug, drug.repartition(5), drug.orderBy(F.desc("row_order"))):
        found = joined_values(layout, ["drugname", "route", "prod_ai"]).collect()
        assert {r["primaryid"]: (r["drugname"], r["route"], r["prod_ai"]) for r in found} == expected


def test_hot_case_keeps_all_values(spark):
    """One case with a third of the rows: every distinct value stays, in order."""
    hot = spark.range(30_000).select(F.lit("q").alias("quarter"), F.lit(7).cast("long").alias("primaryid"),
                                     F.col("id").alias("row_order"), F.concat(F.lit("v"), F.col("id") % 500).alias("pt"))
    rest = spark.range(60_000).select(F.lit("q").alias("quarter"), (F.col("id") + 100).alias("primaryid"),
                                      F.col("id").alias("row_order"), F.lit("w").alias("pt"))
    found = distinct_values(hot.unionByName(rest), ["pt"])
    assert found.count() == 60_001
    assert found.where("primaryid = 7").first()["pt"] == [f"v{i}" for i in range(500)]


def test_first_drug_ties_do_not_depend_on_layout(spark):
    schema = "quarter string, primaryid long, row_order long, drug_seq string, dose_amt string, dose_freq string"
    rows = spark.createDataFrame([("q", 1, 5, "1", "20", "QD"), ("q", 1, 5, "x", "10", "BID"), ("q", 1, 9, "3", "1", "A")], schema)
    for layout in (rows, rows.orderBy("dose_amt"), rows.repartition(3)):
        assert tuple(first_drug(layout).first()) == ("q", 1, 3.0, "10", "BID")


def test_keep_first_by_quarter_then_position(spark):
    rows = demo(spark, [("2022q2", 1, 0, 20), ("2022q1", 1, 5, 10), ("2022q1", 1, 6, 11), ("2022q2", 2, 0, 30),
                        ("2022q2", None, 1, 41), ("2022q1", None, 9, 40), ("other", 3, 0, 50), ("2023q3", 3, 8, 51)])
    kept = {r["primaryid"]: r["age"] for r in keep_first(rows).collect()}
    assert kept == {1: 10, 2: 30, None: 40, 3: 51}


def test_keep_first_limits_groups_before_the_shuffle(spark):
    plan = keep_first(demo(spark, [("2022q1", 1, 0, 1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_assemble(spark):
    tables = CaseTables(
        demo(spark, [("2022q1", 1, 0, 10), ("2022q1", 2, 1, 20), ("2022q1", None, 2, 30), ("2022q2", 1, 0, 11),
                     ("2022q2", 4, 1, 40)]),
        spark.createDataFrame([("2022q1", 1, 0, "A", "oral", "a"), ("2022q2", 1, 0, "B", "oral", "b"),
                               ("2022q1", 9, 0, "Z", "z", "z")], DRUG),
        spark.createDataFrame([("2022q1", 2, 0, "rash")], "quarter string, primaryid long, row_order long, pt string"),
        spark.createDataFrame([("2022q1", 1, "OT"), ("2022q1", 2, "DE"), ("2022q1", 2, "OT"), ("2022q1", 2, None)],
                              "quarter string, primaryid long, outc_cod string"),
        labelled=["2022q1"])
    found = {r["primaryid"]: (r["age"], r["drugname"], r["reactions"], r["serious"]) for r in assemble(tables).collect()}
    assert found == {1: (10, "A", None, 0), 2: (20, None, "rash", 1), None: (30, None, None, 0), 4: (40, None, None, None)}


def test_assemble_without_outcomes_has_no_label(spark):
    assert "serious" not in assemble(CaseTables(demo(spark, [("2022q1", 1, 0, 10)]))).columns


def test_assemble_skips_tables_without_key(spark):
    tables = CaseTables(demo(spark, [("2022q1", 1, 0, 10)]), drug=spark.range(1), reac=spark.range(1))
    assert assemble(tables).columns == ["quarter", "primaryid", "age"]


def test_single_quarter_keeps_repeated_reports(spark):
    tables = CaseTables(demo(spark, [("2022q1", 1, 0, 10), ("2022q1", 1, 1, 11)]))
    assert assemble(tables, one_per_case=False).count() == 2


def test_sampling_before_the_joins_is_the_same(spark):
    tables = CaseTables(demo(spark, [("2022q1", i, i, i) for i in range(50)]),
                        spark.createDataFrame([("2022q1", i, 0, f"d{i}", "r", "a") for i in range(50)], DRUG))
    late = sample_exact(assemble(tables), 12)
    assert sorted(assemble(tables, sample_size=12).collect()) == sorted(late.collect())


def test_union_fills_missing_columns(spark):
    both = union_quarters([spark.range(2).select("id"), spark.range(2).withColumn("x", F.lit(1))])
    assert both.where("x is null").count() == 2


def test_sample_size_is_exact_and_stable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "primaryid")
    ids = {r[0] for r in sample_exact(rows, 777).collect()}
    assert len(ids) == 777
    assert ids == {r[0] for r in sample_exact(rows.repartition(7), 777).collect()}
    assert sample_exact(rows, 50_000).count() == 20_000


def test_splits_partition_the_rows(spark):
    rows = spark.range(10_000).withColumnRenamed("id", "primaryid")
    training, rest = split(rows)
    assert training.count() + rest.count() == 10_000
    assert abs(training.count() - 8_000) < 200
    assert train_flag(rows).where("is_train = 1").count() == training.count()


def test_folds_are_even_per_class(spark):
    rows = spark.range(10_003).select(F.col("id").alias("primaryid"), (F.col("id") % 7 == 0).cast("int").alias("serious"))
    sizes = stratified_folds(rows).groupBy("serious", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in sizes if r["serious"] == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    again = {tuple(r) for r in stratified_folds(rows.repartition(9)).collect()}
    assert again == {tuple(r) for r in stratified_folds(rows).collect()}


def test_rollup_does_not_multiply_rows(spark):
    """A row per item reaches the shuffles, whatever the number of texts, and lists are made where a case's rows lie."""
    rows = spark.createDataFrame([("q", 1, 1, "a", None, "x"), ("q", 1, 1, "b", "r", "x"), ("q", 1, 2, "a", "s", None), ("q", 2, 5, None, None, None)],
                                 "quarter string, primaryid bigint, row_order bigint, drugname string, route string, prod_ai string")
    found = joined_values(rows, ["drugname", "route", "prod_ai"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan
    assert sorted(tuple(r) for r in found.collect()) == [("q", 1, "a | b", "r | s", "x"), ("q", 2, "", "", "")]


def test_values_without_a_position(spark):
    """A value's position is that of its rows that have one, in whatever combination; without any it comes first."""
    rows = spark.createDataFrame([("q", 1, 1, "a", "x"), ("q", 1, None, "b", "y"), ("q", 1, 3, "c", "y"), ("q", 1, 2, "d", None), ("q", 1, 2, "b", "z")],
                                 "quarter string, primaryid bigint, row_order bigint, drugname string, route string")
    found = joined_values(rows, ["drugname", "route"]).first()
    assert (found.drugname, found.route) == ("a | b | d | c", "x | z | y")
    alone = joined_values(rows.withColumn("row_order", F.lit(None).cast("bigint")), ["drugname"]).first()
    assert alone.drugname == "a | b | c | d"


def test_combinations_are_listed_in_order_without_a_list_per_column(spark):
    """Combinations with positions of their own are read off as they come; those that share one go by value."""
    rows = [("q", 1, 3, "b", "x"), ("q", 1, 1, "c", None), ("q", 1, 2, "b", "y"), ("q", 2, 1, "z", "a"), ("q", 2, 1, "a", "z"),
            ("q", 3, None, "m", "n"), ("q", 3, 1, "k", "n")]
    table = spark.createDataFrame(rows, "quarter string, primaryid long, row_order long, drugname string, route string")
    seen, _ = cases._folded(table, ["drugname", "route"], cases.CASE)
    assert {r["primaryid"]: r["plain"] for r in seen.collect()} == {1: True, 2: False, 3: False}
    found = {r["primaryid"]: (r["drugname"], r["route"]) for r in distinct_values(table, ["drugname", "route"]).collect()}
    assert found == {1: (["c", "b"], ["y", "x"]), 2: (["a", "z"], ["a", "z"]), 3: (["m", "k"], ["n"])}


def test_only_wanted_columns_are_rolled_up(spark):
    drug = spark.createDataFrame([("q", 1, 1, "a", "x", "p", "2"), ("q", 1, 2, "b", "x", "p", "3")], DRUG + ", dose_amt string")
    reac = spark.createDataFrame([("q", 1, 1, "r")], "quarter string, primaryid long, row_order long, pt string")
    tables = CaseTables(demo(spark, [("q", 1, 0, 10)]), drug, reac)
    some = assemble(tables, columns=["primaryid", "age", "dose_amt"])
    assert [tuple(r) for r in some.collect()] == [tuple(r) for r in assemble(tables).select("primaryid", "age", "dose_amt").collect()]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "collect_list" not in plan
    assert assemble(tables, columns=["primaryid", "route", "reactions"]).collect() == assemble(tables).select("primaryid", "route", "reactions").collect()


def test_cases_of_few_rows_move_once(spark, monkeypatch):
    """Only cases in crowded groups are folded before they meet; the case table is the same."""
    monkeypatch.setattr(cases, "CROWD_ROWS", 100)
    rows = [("q", 7, i % 40 if i % 9 else None, f"d{i * 7 % 5}" if i % 11 else None, f"r{i % 3}", "p", str(i % 4)) for i in range(300)]
    rows += [(q, k, i // 2, f"d{i * k % 4}", None if i % 2 else "r", f"p{i}", str(i)) for q in ("q", "s") for k in range(20, 60) for i in range(4)]
    drug = spark.createDataFrame([*rows, ("q", None, 1, "z", "z", "z", "9")], DRUG + ", dose_amt string")
    reac = drug.select("quarter", "primaryid", "row_order", F.col("drugname").alias("pt"))
    tables = CaseTables(demo(spark, [(q, k, 0, 1) for q in ("q", "s") for k in (7, *range(20, 61))]), drug, reac)
    crowded = cases.crowds(tables)
    assert len(crowded) == 1

    def found(crowded):
        return sorted(map(repr, assemble(tables, ["q", "s"], one_per_case=False, crowded=crowded).collect()))

    assert found(crowded) == found([]) == found(None)
    plans = {name: cases.drug_summary(drug, crowded=groups)._jdf.queryExecution().executedPlan().toString()
             for name, groups in (("folded", None), ("some", crowded), ("none", []))}
    assert {name: plan.count("Exchange hashpartitioning") for name, plan in plans.items()} == {"folded": 2, "some": 2, "none": 1}
    assert {name: "SortAggregate" in plan for name, plan in plans.items()} == {"folded": True, "some": True, "none": False}
    monkeypatch.setattr(cases, "MOST_CROWDS", 0)
    assert cases.crowds(tables) is None
    assert cases.crowds(CaseTables(tables.demo)) == []
