"""Global order without a global window.

Running totals, row numbers and exact quantiles over a whole table need every
row's place in one order. A window over the whole table would run in one task,
so the order is cut into buckets: per-bucket totals are few, their running sums
give each bucket its offset, and the window runs inside buckets only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.hashing import SPLIT_SALT, portable_hash

STRIDE = 32
CUTS = STRIDE * STRIDE - 1


def _plan_of(grouped: DataFrame, order: str, totals: Sequence[str], by: str | None) -> Column:
    """Struct of the ``cuts`` and the whole sum of each total, of the row's own group.

    A scalar subquery over one row per group; ``by`` is a column with few values
    (a class, a fold, a feature name). It reads the same columns as the main
    branch, so the shuffle that built ``grouped`` is run once and reused.
    """
    shares = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    found = [F.percentile_approx(order, shares, F.lit(10000)).alias("cuts"), *[F.sum(t).alias(t) for t in totals]]
    plan = F.struct("cuts", *totals)
    if by is None:
        return grouped.agg(*found).select(plan.alias("plan")).scalar()
    pairs = grouped.where(F.col(by).isNotNull()).groupBy(by).agg(*found).select(F.struct(by, plan.alias("plan")).alias("pair"))
    return F.element_at(pairs.agg(F.map_from_entries(F.collect_list("pair"))).scalar(), F.col(by))


def _bucket(value: Column, cuts: Column) -> Column:
    """How many cut points lie below ``value``, by coarse and fine search."""
    coarse = F.transform(F.sequence(F.lit(STRIDE), F.lit(CUTS), F.lit(STRIDE)), lambda i: F.element_at(cuts, i))
    block = F.size(F.filter(coarse, lambda c: c < value))
    fine = F.slice(cuts, block * STRIDE + 1, STRIDE)
    return block * STRIDE + F.size(F.filter(fine, lambda c: c < value))


def running_totals(grouped: DataFrame, order: str, totals: Sequence[str], by: str | None = None) -> DataFrame:
    """Add ``<total>_before``, the sum of a total over all rows earlier in ``order``, and ``<total>_all``.

    ``grouped`` has one row per (by, order) value. Buckets are cut at quantiles
    of those rows, so they stay even however the values cluster.
    """
    group = [by] if by else []
    rows = (grouped.withColumn("_plan", _plan_of(grouped, order, totals, by))
            .withColumn("_bucket", _bucket(F.col(order), F.col("_plan.cuts")))
            .select(*grouped.columns, "_bucket", *[F.col(f"_plan.{t}").alias(f"{t}_all") for t in totals]))
    # At most CUTS + 1 rows per group reach this window.
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*group, "_bucket").agg(*[F.sum(t).alias(f"_{t}") for t in totals])
               .select(*group, "_bucket", *[F.coalesce(F.sum(f"_{t}").over(earlier), F.lit(0)).alias(f"_{t}")
                                            for t in totals]))
    inside = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # Every bucket has an offset; a left join keeps Catalyst from pushing a null
    # test on the bucket, and with it the search, below the aggregation.
    return (rows.select("*", *[F.coalesce(F.sum(t).over(inside), F.lit(0)).alias(f"_in_{t}") for t in totals])
            .join(offsets, [*group, "_bucket"], "left")
            .select(*grouped.columns, *[(F.col(f"_in_{t}") + F.col(f"_{t}")).alias(f"{t}_before") for t in totals],
                    *[f"{t}_all" for t in totals]))


def frequency_table(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Rows ``_n`` per distinct non-null value; repeats fold before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*([by] if by else []), value).agg(F.count("*").alias("_n"))


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: str | None = None) -> DataFrame:
    """Interpolated quantiles of the non-null values, as array ``quantiles``, with their count ``n``."""
    return quantiles_of(frequency_table(df, value, by), value, shares, by)


def quantiles_of(frequencies: DataFrame, value: str, shares: Sequence[float], by: str | None = None) -> DataFrame:
    """As ``exact_quantiles``, from a ``frequency_table``."""
    group = [by] if by else []
    ranked = running_totals(frequencies, value, ["_n"], by)
    places = [F.lit(float(share)) * (F.col("_n_all") - 1) for share in shares]

    def at(place: Column) -> Column:
        covers = (F.col("_n_before") <= place) & (place < F.col("_n_before") + F.col("_n"))
        return F.max(F.when(covers, F.col(value).cast("double")))

    picks = []
    for i, place in enumerate(places):
        picks += [at(F.floor(place)).alias(f"_low{i}"), at(F.ceil(place)).alias(f"_high{i}")]

    def blend(i: int, place: Column) -> Column:
        return F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (place - F.floor(place))

    return (ranked.groupBy(*group, "_n_all").agg(*picks)
            .select(*group, F.col("_n_all").alias("n"),
                    F.array(*[blend(i, place) for i, place in enumerate(places)]).alias("quantiles")))


# Bits of the 31-bit hash that form a bucket: 4096 buckets, even by construction.
BUCKET_SHIFT = 19


def number_rows(df: DataFrame, key: str, salt: int = SPLIT_SALT, by: str | None = None) -> DataFrame:
    """Add ``row_no``, counting from 1 in order of (hash of key, key), within ``by`` if given.

    ``key`` must be unique, as it is in a case table; one row may have none.
    Rows without a group get no number.
    """
    group = [by] if by else []
    rows = df.withColumn("_hash", portable_hash(F.col(key), salt))
    rows = rows.withColumn("_bucket", F.shiftright("_hash", BUCKET_SHIFT))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"))
               .select(*group, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", key)
    return (rows.withColumn("_place", F.row_number().over(inside))
            .join(offsets, [*group, "_bucket"], "left")
            .withColumn("row_no", F.col("_offset") + F.col("_place"))
            .drop("_hash", "_bucket", "_place", "_offset"))


def sample_exact(df: DataFrame, n: int, key: str = "primaryid", salt: int = SPLIT_SALT) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones on every run and layout.

    Bucket sizes tell which bucket holds the n-th row, so only about n rows are
    shuffled, and ranked within their buckets. ``key`` must be unique; one row
    may have none.
    """
    rows = df.withColumn("_hash", portable_hash(F.col(key), salt))
    rows = rows.withColumn("_bucket", F.shiftright("_hash", BUCKET_SHIFT))
    upto = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    filled = (rows.groupBy("_bucket").agg(F.count("*").alias("_size"))
              .withColumn("_upto", F.sum("_size").over(upto)))
    cut = filled.where(F.col("_upto") - F.col("_size") < n).agg(
        F.struct(F.max("_bucket").alias("bucket"),
                 (F.lit(n) - F.max(F.col("_upto") - F.col("_size"))).alias("left"))).scalar()
    inside = Window.partitionBy("_bucket").orderBy("_hash", key)
    return (rows.where(F.col("_bucket") <= cut["bucket"]).withColumn("_place", F.row_number().over(inside))
            .where((F.col("_bucket") < cut["bucket"]) | (F.col("_place") <= cut["left"]))
            .drop("_hash", "_bucket", "_place"))
