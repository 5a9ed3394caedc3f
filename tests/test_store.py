"""Case tables that grow by quarters, and stored raw tables."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from caseloom.commits import commit_file
from caseloom.operators.cases import CaseTables, assemble
from caseloom.sources import proxies, sinks
from caseloom.sources.sinks import store_tables, stored_tables, write_cases
from caseloom.sources.store import CaseStore, load_files
from conftest import SMALL

QUARTERS = ["2022q1", "2022q2", "2022q3"]


@pytest.fixture(scope="module")
def quarters(spark):
    """Three quarters with reports sent again, one without outcomes, one null key in each."""
    tables = proxies.case_tables(spark, SMALL, country=False)
    rank = F.col("primaryid") % 3
    own = F.element_at(F.array(*[F.lit(q) for q in QUARTERS]), rank.cast("int") + 1)
    demo = tables.demo.withColumn("quarter", own)
    again = demo.where("primaryid % 7 = 0").withColumns({"quarter": F.lit("2022q2"), "age": F.col("age") + 1})
    nobody = demo.limit(1).withColumn("primaryid", F.lit(None).cast("bigint"))
    demo = demo.unionByName(again).unionByName(nobody).unionByName(nobody.withColumn("quarter", F.lit("2022q2"))).cache()

    def of(quarter):
        cut = [t.withColumn("quarter", F.lit(quarter)).join(demo.where(F.col("quarter") == quarter).select("primaryid"), "primaryid", "left_semi")
               for t in (tables.drug, tables.reac, tables.outc)]
        return CaseTables(demo.where(F.col("quarter") == quarter), cut[0], cut[1], None if quarter == "2022q3" else cut[2])
    return {q: of(q) for q in QUARTERS}


def at_once(spark, quarters, names):
    def union(part):
        tables = [getattr(quarters[q], part) for q in names if getattr(quarters[q], part) is not None]
        out = tables[0] if tables else None
        for t in tables[1:]:
            out = out.unionByName(t)
        return out
    labelled = [q for q in names if quarters[q].outc is not None]
    return assemble(CaseTables(*[union(p) for p in ("demo", "drug", "reac", "outc")], labelled), QUARTERS)


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


@pytest.mark.parametrize("order", list(permutations(QUARTERS))[::2])
def test_any_order_equals_one_load(spark, quarters, tmp_path, order):
    store = CaseStore(spark, str(tmp_path), QUARTERS)
    for n, quarter in enumerate(order):
        assert store.load(quarter, quarters[quarter]) == n
        assert rows_of(store.cases()) == rows_of(at_once(spark, quarters, [q for q in QUARTERS if q in order[:n + 1]]))
    assert store.cases(["2022q1"]).where("quarter <> '2022q1'").isEmpty()


def test_loads_read_their_own_quarter(spark, quarters, tmp_path):
    """Rolled up are reports new to the store only, whose number a load's own files give."""
    store = CaseStore(spark, str(tmp_path), QUARTERS)
    store.load("2022q1", quarters["2022q1"])
    store.load("2022q2", quarters["2022q2"])
    first, second = (spark.read.parquet(f"{tmp_path}/{load.folder}/cases") for load in store.log())
    assert second.join(first, "primaryid").isEmpty()
    assert second.count() < quarters["2022q2"].demo.count()
    assert store.cases().count() == first.count() + second.count()


def test_broken_and_repeated_loads(spark, quarters, tmp_path):
    store = CaseStore(spark, str(tmp_path), QUARTERS)
    assert store.cases().count() == 0
    store.load("2022q1", quarters["2022q1"])
    before = rows_of(store.cases())
    # A load that ended before its entry was written.
    quarters["2022q2"].demo.write.parquet(f"{tmp_path}/2022q2-broken/cases")
    assert rows_of(store.cases()) == before
    with pytest.raises(ValueError):
        store.load("2022q1", quarters["2022q1"])
    # Another load took the number.
    assert not commit_file(spark, f"{tmp_path}/log/00000000.json", "{}")
    assert [load.quarter for load in store.log()] == ["2022q1"]


def test_files(spark, tmp_path):
    for quarter, text in (("2022q1", "1$50\n2$60\n"), ("2022q2", "2$61\n3$70\n")):
        folder = tmp_path / "raw" / quarter
        folder.mkdir(parents=True)
        (folder / "DEMO.txt").write_text("primaryid$age\n" + text)
        (folder / "REAC.txt").write_text("primaryid$pt\n2$rash\n3$cough\n")
    store = CaseStore(spark, str(tmp_path / "store"))
    with pytest.warns(UserWarning):
        for quarter in ("2022q2", "2022q1"):
            load_files(store, str(tmp_path / "raw"), quarter)
    assert sorted((r.primaryid, r.age, r.quarter, r.reactions) for r in store.cases().collect()) == [
        (1, "50", "2022q1", None), (2, "60", "2022q1", "rash"), (3, "70", "2022q2", "cough")]


def test_cases_of_other_quarters_stay(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2022q1"), (2, "2022q2")], "primaryid long, quarter string")
    write_cases(rows, str(tmp_path / "cases"))
    write_cases(spark.createDataFrame([(3, "2022q2")], "primaryid long, quarter string"), str(tmp_path / "cases"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "cases")).select("primaryid", "quarter").collect()) == [
        (1, "2022q1"), (3, "2022q2")]


def test_stored_tables_join_where_they_lie(spark, tmp_path):
    tables = proxies.case_tables(spark, SMALL, country=False)
    name = f"stored_{tmp_path.name}".replace("-", "_").lower()
    try:
        for quarter in proxies.PROXY_QUARTERS:
            store_tables(CaseTables(*[getattr(tables, p).where(F.col("quarter") == quarter) for p in ("demo", "drug", "reac", "outc")]),
                         name, str(tmp_path / "stored"), 8)
        # A quarter stored again replaces itself alone.
        store_tables(CaseTables(tables.demo.where("quarter = '2022q2'")), name, str(tmp_path / "stored"), 8)
        stored = stored_tables(spark, name)
        assert rows_of(assemble(stored)) == rows_of(assemble(tables))
        assert rows_of(assemble(stored_tables(spark, name, ["2022q1"]))) == rows_of(assemble(tables).where("quarter = '2022q1'"))
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            # Reports of several quarters are told apart before, by ``keep_first``; the roll-ups and the three joins move nothing.
            plan = assemble(stored, one_per_case=False)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan, plan
    finally:
        for part in ("demo", "drug", "reac", "outc"):
            spark.sql(f"drop table if exists {name}_{part}")


def test_buckets_grow_with_the_first_quarter(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BUCKET_ROWS", 10)
    name = f"grown_{tmp_path.name}".replace("-", "_").lower()
    try:
        for quarter, n in (("2022q1", 300), ("2022q2", 900)):
            demo = spark.range(n).select(F.col("id").alias("primaryid"), F.lit(quarter).alias("quarter"), F.col("id").alias("row_order"))
            store_tables(CaseTables(demo, outc=demo.limit(5).withColumn("outc_cod", F.lit("DE"))), name, str(tmp_path / "stored"))
        for part in ("demo", "outc"):
            kept = spark.sql(f"describe extended {name}_{part}").where("col_name = 'Num Buckets'").first()
            assert kept["data_type"] == "30"
        assert stored_tables(spark, name).demo.count() == 1200
    finally:
        for part in ("demo", "outc"):
            spark.sql(f"drop table if exists {name}_{part}")


def test_loads_count_crowds_and_join_moved_quarters_only(spark, quarters, tmp_path, monkeypatch):
    """Cases of few rows are rolled up without a fold, and only a quarter that lost reports is joined with those gone."""
    seen = []

    def assembled(*args, **options):
        seen.append(options["crowded"])
        return assemble(*args, **options)

    monkeypatch.setattr("caseloom.sources.store.assemble", assembled)
    store = CaseStore(spark, str(tmp_path), QUARTERS)
    joins = []
    for quarter in ("2022q2", "2022q1", "2022q3"):
        store.load(quarter, quarters[quarter])
        joins.append(store.cases()._jdf.queryExecution().optimizedPlan().toString().count("Join LeftAnti"))
    assert seen == [[], [], []]
    assert joins == [0, 1, 1]
    assert rows_of(store.cases()) == rows_of(at_once(spark, quarters, QUARTERS))
