"""Quantiles from mergeable sketches with a stated relative error.

A value falls in bucket ceil(log x / log g), g = (1 + e) / (1 - e), by its sign;
zero has a bucket of its own. A sketch is the table of bucket counts. Sketches of
parts merge by adding counts, and any value of a bucket is within the share e of
the bucket's middle, 2 g^b / (1 + g). So a quantile is found with relative error
e, however the parts were cut. A double falls in one of 1,500 / e buckets at
most, which bounds sketches and windows whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01


def _growth(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("the error is a share between 0 and 1")
    return (1 + error) / (1 - error)


def sketch(df: DataFrame, value: str, error: float = ERROR, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """``by``, ``sign``, ``bucket`` and ``n``: counts of the non-null values, or sums of ``count``, by bucket."""
    size = F.abs(F.col(value).cast("double"))
    bucket = F.when(size > 0, F.ceil(F.log(size) / F.lit(math.log(_growth(error))))).otherwise(F.lit(0)).cast("int")
    return (df.where(F.col(value).isNotNull()).select(*by, F.signum(F.col(value).cast("double")).cast("int").alias("sign"),
                                                     bucket.alias("bucket"), (F.col(count) if count else F.lit(1)).alias("n"))
            .groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n")))


def merge(sketches: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One sketch of all rows that ``sketches`` of the same error hold."""
    rows = reduce(DataFrame.unionByName, sketches)
    return rows.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketched: DataFrame, shares: Sequence[float], error: float = ERROR, by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``n`` and ``quantiles``: for each share the middle of the bucket that holds the value of rank ceil(share * n)."""
    growth = _growth(error)
    middle = F.col("sign") * 2 * F.pow(F.lit(growth), F.col("bucket")) / (1 + growth)
    # Bounded by the buckets of a double.
    upto = Window.partitionBy(*by).orderBy("middle").rowsBetween(Window.unboundedPreceding, 0)
    counted = (sketched.withColumn("middle", middle).withColumn("upto", F.sum("n").over(upto))
               .withColumn("all", F.sum("n").over(Window.partitionBy(*by))))

    def at(share: float) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("all")))
        return F.min(F.when(F.col("upto") >= rank, F.col("middle")))

    return (counted.groupBy(*by, "all").agg(*[at(share).alias(f"_{i}") for i, share in enumerate(shares)])
            .select(*by, F.col("all").alias("n"), F.array(*[f"_{i}" for i in range(len(shares))]).alias("quantiles")))
