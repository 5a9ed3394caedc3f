"""Where case tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.cases import CaseTables, usable

# Rows of the largest table of the first quarter for each file that its stored tables are dealt into, by case; the fewest files.
BUCKET_ROWS, LEAST_BUCKETS = 250_000, 8
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"
RAW_TABLES = ["demo", "drug", "reac", "outc"]


def write_csv(df: DataFrame, path: str) -> None:
    """Text with a header row in every part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_cases(df: DataFrame, path: str) -> None:
    """Parquet by quarter, so that jobs on some quarters read only those.

    Quarters that ``df`` holds are replaced, others stay.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("quarter").parquet(path)


def _buckets(tables: CaseTables, name: str) -> int:
    """How many buckets the stored tables have, or, while there are none, what the number of rows asks for."""
    given = [getattr(tables, part) for part in RAW_TABLES if usable(getattr(tables, part))]
    spark = given[0].sparkSession
    for part in RAW_TABLES:
        if spark.catalog.tableExists(f"{name}_{part}"):
            return int(spark.sql(f"describe extended {name}_{part}").where("col_name = 'Num Buckets'").first()["data_type"])
    return max(LEAST_BUCKETS, -(-max(table.count() for table in given) // BUCKET_ROWS))


def store_tables(tables: CaseTables, name: str, folder: str, buckets: int | None = None) -> None:
    """Raw tables as ``<name>_demo`` and so on, by quarter and in buckets by (quarter, case); files below ``folder``.

    Quarters that are stored already are replaced, others stay. Roll-ups and
    joins by case then read each bucket where it lies: nothing moves. The first
    quarter's size decides how many buckets there are, unless ``buckets`` says it.
    """
    buckets = buckets or _buckets(tables, name)
    for part in RAW_TABLES:
        table = getattr(tables, part)
        if not usable(table):
            continue
        spark, target = table.sparkSession, f"{name}_{part}"
        # ``load`` is the quarter again: Spark does not bucket by a partition column.
        rows = table.withColumn("load", F.col("quarter"))
        rows = rows.repartition(buckets, "quarter", "primaryid")
        if not spark.catalog.tableExists(target):
            (rows.write.partitionBy("load").bucketBy(buckets, "quarter", "primaryid").sortBy("quarter", "primaryid")
             .option("path", f"{folder}/{part}").saveAsTable(target))
        else:
            columns = [f.name for f in spark.table(target).schema]
            # Tables follow the session here, not an option of the write.
            before = spark.conf.get(OVERWRITE)
            spark.conf.set(OVERWRITE, "dynamic")
            try:
                rows.select(*columns).write.insertInto(target, overwrite=True)
            finally:
                spark.conf.set(OVERWRITE, before)


def stored_tables(spark: SparkSession, name: str, quarters: list[str] | None = None) -> CaseTables:
    """What ``store_tables`` has written, all quarters or some."""
    def read(part: str) -> DataFrame | None:
        if not spark.catalog.tableExists(f"{name}_{part}"):
            return None
        rows = spark.table(f"{name}_{part}")
        return (rows.where(F.col("load").isin(quarters)) if quarters else rows).drop("load")

    return CaseTables(*[read(part) for part in RAW_TABLES])
