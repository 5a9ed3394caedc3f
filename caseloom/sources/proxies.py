"""The four raw report tables, shaped from the star-schema test tables.

Orders stand for reports, line items for drugs and reactions, order priorities
for outcomes. ``row_order`` is the position of a row within its case; rows that
tie on it agree in every column that is rolled up by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.config import DEMO_REACTIONS
from caseloom.operators.cases import CaseTables

PROXY_QUARTERS = ["2022q1", "2022q2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def demo(spark: SparkSession, sf_dir: str, country: bool = True) -> DataFrame:
    """One row per report. ``country=False`` saves the joins for jobs that do not use it."""
    rows = table(spark, sf_dir, "orders")
    columns = {
        "primaryid": "o_orderkey",
        "age": "case when o_orderkey % 17 = 0 then null "
               "else cast(1 + (o_orderkey * 7 + o_custkey * 13) % 100 as int) end",
        "sex": "case when o_custkey % 20 < 9 then 'M' when o_custkey % 20 < 18 then 'F' else 'UNK' end",
        "wt": "case when o_orderkey % 29 = 0 then null else 30.0D + ((o_custkey * 31) % 1701) / 10.0D end",
        "quarter": "case when o_orderkey % 2 = 0 then '2022q1' else '2022q2' end",
        "row_order": "o_orderkey",
    }
    if country:
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        rows = (rows.join(customers, F.col("o_custkey") == F.col("c_custkey"))
                .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
        columns["occr_country"] = "n_name"
    return rows.selectExpr(*[f"{body} as {name}" for name, body in columns.items()])


def overlapping_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``demo`` with every tenth report of the first quarter sent again, changed, in the second."""
    rows = demo(spark, sf_dir, country=False)
    resent = (rows.where("quarter = '2022q1' and primaryid % 10 = 0")
              .withColumns({"age": F.col("age") + 1, "quarter": F.lit("2022q2")}))
    return rows.unionByName(resent)


def drug(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey as primaryid",
        "cast(l_linenumber as bigint) as drug_seq",
        "p_name as drugname",
        "case when l_partkey % 23 = 0 then null else lower(p_type) end as route",
        "p_brand as prod_ai",
        "case when l_partkey % 31 = 0 then 'unk' else cast(cast(l_quantity * 20 as int) as string) end as dose_amt",
        "case l_suppkey % 5 when 0 then 'QD' when 1 then 'BID' when 2 then 'TID' "
        "when 3 then 'QID' else 'PRN' end as dose_freq",
        "cast(1 + (l_partkey * 11 + l_suppkey) % 364 as int) as dur",
        "case l_returnflag when 'A' then 'Y' when 'N' then 'N' else 'U' end as dechal",
        "case l_linestatus when 'F' then 'Y' else 'N' end as rechal",
        "case when l_orderkey % 2 = 0 then '2022q1' else '2022q2' end as quarter",
        "l_linenumber * 1099511627776 + l_partkey as row_order",
    )


def reac(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = ", ".join(f"'{term}'" for term in DEMO_REACTIONS)
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as primaryid",
        f"element_at(array({terms}), cast(l_suppkey % 10 as int) + 1) as pt",
        "case when l_orderkey % 2 = 0 then '2022q1' else '2022q2' end as quarter",
        "l_linenumber * 1099511627776 + l_suppkey as row_order",
    )


def outc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderkey as primaryid",
        "case o_orderpriority when '1-URGENT' then 'HO' when '2-HIGH' then 'DE' "
        "when '3-MEDIUM' then 'OT' else 'RI' end as outc_cod",
        "case when o_orderkey % 2 = 0 then '2022q1' else '2022q2' end as quarter",
    )


def case_tables(spark: SparkSession, sf_dir: str, country: bool = True) -> CaseTables:
    return CaseTables(demo(spark, sf_dir, country), drug(spark, sf_dir),
                      reac(spark, sf_dir), outc(spark, sf_dir))
