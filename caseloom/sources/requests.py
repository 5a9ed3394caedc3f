"""Score requests, as a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.config import REQUEST_DEFAULTS

REQUEST_SCHEMA = T.StructType([
    T.StructField("primaryid", T.LongType()),
    T.StructField("drugname", T.StringType()), T.StructField("route", T.StringType()),
    T.StructField("prod_ai", T.StringType()), T.StructField("reactions", T.StringType()),
    T.StructField("age", T.DoubleType()), T.StructField("wt", T.DoubleType()), T.StructField("sex", T.StringType()),
    T.StructField("dose_amt", T.DoubleType()), T.StructField("dose_freq", T.StringType()),
    T.StructField("dur", T.DoubleType()),
])
TIMED_SCHEMA = T.StructType([*REQUEST_SCHEMA, T.StructField("received", T.TimestampType())])


def distinct_requests(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Timed requests without those sent again: equal in every field but ``received``, as nulls are to each other.

    A stream keeps a request for ``late`` after it was received, as measured by
    the newest one seen, and forgets it then. A request that comes later than
    that is dropped, repeat or not, and counted in the query's progress;
    ``unscored`` finds it. One without ``received`` counts as late. In a table
    the earliest of equal requests stays, and nothing is late.
    """
    fields = [name for name in requests.columns if name != "received"]
    if requests.isStreaming:
        return requests.withWatermark("received", late).dropDuplicatesWithinWatermark(fields)
    return requests.groupBy(*fields).agg(F.min("received").alias("received")).select(*requests.columns)


def unscored(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """Requests of a table that no row of ``scored`` answers: those a stream dropped as late."""
    return requests.join(scored.select(F.col("primaryid").alias("_scored")), F.col("primaryid").eqNullSafe(F.col("_scored")), "left_anti")


def with_request_defaults(requests: DataFrame) -> DataFrame:
    """Add the model inputs a request does not carry, as constants."""
    return requests.withColumns({name: F.lit(value) for name, value in REQUEST_DEFAULTS.items()})


def read_request_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None, timed: bool = False) -> DataFrame:
    """Parquet files of requests as they arrive in a folder; ``timed`` ones say when they were ``received``."""
    reader = spark.readStream.schema(TIMED_SCHEMA if timed else REQUEST_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)
