"""Tabular preprocessing: fitted once, applied to batches and streams alike."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.config import CATEGORICAL_FEATURES, FEATURES, NUMERIC_FEATURES
from caseloom.functions.numbers import to_number
from caseloom.functions.text import narrative
from caseloom.operators.quantilesketch import quantiles, sketch
from caseloom.operators.ranking import exact_quantiles
from caseloom.session import materialize

UNKNOWN = "UNKNOWN"
# Values of all categorical features up to which their codes are looked up in the row: some 20 MB.
LOOKUP_VALUES = 200_000
NARRATIVE_PARTS = ["drugname", "route", "prod_ai", "reactions"]
NUMERIC_SCHEMA = T.StructType([T.StructField("feature", T.StringType()), T.StructField("median", T.DoubleType()),
                               T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])
CATEGORY_SCHEMA = T.StructType([T.StructField("feature", T.StringType()), T.StructField("value", T.StringType()),
                                T.StructField("code", T.IntegerType())])


def with_narrative(cases: DataFrame) -> DataFrame:
    """Add the cleaned ``narrative``; parts the table lacks count as null."""
    parts = [F.col(c).cast("string") if c in cases.columns else F.lit(None).cast("string") for c in NARRATIVE_PARTS]
    return cases.withColumn("narrative", narrative(*parts))


def engineered_flags(df: DataFrame) -> dict[str, Column]:
    """Five 0/1 risk flags with stand-ins for missing values."""

    def filled(name: str, stand_in: float) -> Column:
        return F.coalesce(to_number(df, name), F.lit(float(stand_in)))

    return {
        "is_elderly": (filled("age", 55) > 65).cast("int"),
        "is_pediatric": (filled("age", 55) < 18).cast("int"),
        "polypharmacy": (filled("drug_seq", 1) > 5).cast("int"),
        "high_dose": (filled("dose_amt", 0) > 500).cast("int"),
        "long_duration": (filled("dur", 0) > 90).cast("int"),
    }


def numeric_stats(df: DataFrame, error: float | None = None) -> DataFrame:
    """Per numeric feature: median, then mean and population deviation after filling with it.

    The median is exact, or with ``error`` from a sketch, to that relative error. An all-null column is filled with 0; a constant one is not scaled.
    """
    numbers = df.select(*[to_number(df, c).alias(c) for c in NUMERIC_FEATURES])
    stacked = numbers.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
                                                for c in NUMERIC_FEATURES])))
    medians = exact_quantiles(stacked, "value", [0.5], by="feature") if error is None else quantiles(
        sketch(stacked, "value", error, ["feature"]), [0.5], error, ["feature"])
    found = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.col("quantiles")[0])))).scalar()
    filled = numbers.withColumn("_median", found)
    filled = filled.select("_median", *[F.coalesce(c, F.element_at("_median", F.lit(c)), F.lit(0.0)).alias(c)
                                        for c in NUMERIC_FEATURES])
    row = filled.agg(F.first("_median").alias("_median"),
                     *[F.avg(c).alias(f"mean_{c}") for c in NUMERIC_FEATURES],
                     *[F.stddev_pop(c).alias(f"std_{c}") for c in NUMERIC_FEATURES])
    lines = [F.struct(F.lit(c).alias("feature"),
                      F.coalesce(F.element_at("_median", F.lit(c)), F.lit(0.0)).alias("median"),
                      F.col(f"mean_{c}").alias("mean"),
                      F.when(F.col(f"std_{c}") == 0, 1.0).otherwise(F.col(f"std_{c}")).alias("std"))
             for c in NUMERIC_FEATURES]
    return row.select(F.inline(F.array(*lines)))


def category_value(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(UNKNOWN))


def category_values(df: DataFrame) -> DataFrame:
    """Distinct (feature, value) of the categorical features; hot values fold before the shuffle."""
    present = [c for c in CATEGORICAL_FEATURES if c in df.columns]
    if not present:
        return df.select(F.lit("").alias("feature"), F.lit("").alias("value")).limit(0)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), category_value(c).alias("value")) for c in present])
    return df.select(F.inline(pairs)).distinct()


def category_map(df: DataFrame) -> DataFrame:
    """The values of each categorical feature numbered from 0 in sorted order, in ranges of a written table."""
    return numbered_by_range(category_values(df))


def numbered_by_range(values: DataFrame) -> DataFrame:
    """Numbers of (feature, value) within each feature, in range partitions of a written table.

    No task sees more than one range, however many values a feature has.
    """
    ranged = materialize(values.repartitionByRange("feature", "value")
                         .withColumn("_range", F.spark_partition_id()), "category-values")
    earlier = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("feature", "_range").agg(F.count("*").alias("_size"))
               .select("feature", "_range", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")))
    place = F.row_number().over(Window.partitionBy("feature", "_range").orderBy("value"))
    return (ranged.withColumn("_place", place).join(offsets, ["feature", "_range"], "left")
            .select("feature", "value", (F.col("_offset") + F.col("_place") - 1).cast("int").alias("code")))


@dataclass(frozen=True)
class FittedFeatures:
    """What ``fit_features`` learned: five rows of numbers and the category codes."""

    numeric: dict[str, tuple[float, float, float]]
    categories: DataFrame
    fallback: dict[str, int]
    sizes: dict[str, int]
    feature_names: tuple[str, ...] = tuple(FEATURES)

    @property
    def n_features(self) -> int:
        return len(self.feature_names)

    def scaled(self, df: DataFrame) -> dict[str, Column]:
        """Numeric features filled with the median and standardized."""
        return scaled(self.numeric, df)

    def encoded(self, df: DataFrame) -> DataFrame:
        """Add ``code_<feature>``; unseen values take the code of UNKNOWN if fitted, else 0.

        The features of the fewest values, up to ``LOOKUP_VALUES`` together, are
        one lookup table in the row's own stage, without a join. Beyond that a
        table of cases takes one join for all other features, a stream one for each.
        """
        known = [c for c in CATEGORICAL_FEATURES if c in df.columns and c in self.fallback]
        few, total = [], 0
        for name in sorted(known, key=lambda c: self.sizes[c]):
            total += self.sizes[name]
            if total <= LOOKUP_VALUES:
                few.append(name)
        many = [c for c in known if c not in few]
        if len(many) > 1 and not df.isStreaming and "primaryid" in df.columns:
            coded = self._joined(df, many)
        else:
            coded = self._joined_each(df, many)
        codes = self._looked_up(few) | {c: F.lit(0) for c in CATEGORICAL_FEATURES if c not in known}
        names = [f"code_{c}" for c in CATEGORICAL_FEATURES]
        return coded.withColumns({f"code_{c}": code for c, code in codes.items()}).select(*[c for c in df.columns if c not in names], *names)

    def _looked_up(self, known: Sequence[str]) -> dict[str, Column]:
        """Codes by hash: the table has a slot per hash, each a map of the few (feature, value) that fall there."""
        if not known:
            return {}
        slots = 1 << max(0, sum(self.sizes[c] for c in known) - 1).bit_length()

        def key(feature: Column, value: Column) -> Column:
            return F.concat_ws("\0", feature, value)

        def slot(of: Column) -> Column:
            return F.pmod(F.xxhash64(of), F.lit(slots)).cast("int")

        own = key(F.col("feature"), F.col("value"))
        entries = (self.categories.where(F.col("feature").isin(list(known))).groupBy(slot(own).alias("slot"))
                   .agg(F.map_from_entries(F.collect_list(F.struct(own, "code"))).alias("codes")))
        every = self.categories.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(entries, "slot", "left")
        maps = F.transform(F.array_sort(F.collect_list(F.struct("slot", F.map_entries("codes").alias("codes")))),
                           lambda s: F.map_from_entries(s["codes"]))
        # At most LOOKUP_VALUES entries: one array for each executor.
        table = every.agg(maps).scalar()
        codes = {}
        for name in known:
            wanted = key(F.lit(name), category_value(name))
            codes[name] = F.coalesce(F.try_element_at(F.get(table, slot(wanted)), wanted), F.lit(self.fallback[name]))
        return codes

    def _joined(self, df: DataFrame, known: Sequence[str]) -> DataFrame:
        """Codes by one join: a row per feature, of which the first carries the case; keys of cases are unique."""
        carried = [c for c in df.columns if c != "primaryid"]
        pairs = F.array(*[F.struct(F.lit(i).alias("field"), F.lit(c).alias("feature"), category_value(c).alias("value"),
                                   (F.struct(*carried) if i == 0 else F.lit(None)).alias("case")) for i, c in enumerate(known)])
        coded = df.select("primaryid", F.inline(pairs)).join(self.categories, ["feature", "value"], "left")
        codes = {c: F.coalesce(F.max(F.when(F.col("field") == i, F.col("code"))), F.lit(self.fallback[c])) for i, c in enumerate(known)}
        whole = coded.groupBy("primaryid").agg(F.first("case", ignorenulls=True).alias("case"),
                                               *[code.alias(f"code_{c}") for c, code in codes.items()])
        return whole.select(*[F.col("primaryid") if c == "primaryid" else F.col("case")[c].alias(c) for c in df.columns],
                            *[F.col(f"code_{c}") for c in known])

    def _joined_each(self, df: DataFrame, known: Sequence[str]) -> DataFrame:
        """Codes by one join for each feature, which a stream can do without state."""
        coded = df
        for name in known:
            codes = (self.categories.where(F.col("feature") == name)
                     .select(F.col("value").alias("_value"), F.col("code").alias("_code")))
            coded = coded.withColumn("_value", category_value(name))
            coded = (coded.join(codes, "_value", "left")
                     .withColumn(f"code_{name}", F.coalesce("_code", F.lit(self.fallback[name]))).drop("_value", "_code"))
        return coded

    def transform(self, df: DataFrame, keep: Sequence[str] = ("primaryid", "serious")) -> DataFrame:
        """``keep`` columns that exist, then the features as doubles in their fixed order."""
        numbers, flags = self.scaled(df), engineered_flags(df)
        coded = self.encoded(df)
        codes = {c: F.col(f"code_{c}") for c in CATEGORICAL_FEATURES}
        features = numbers | codes | flags
        return coded.select(*[c for c in keep if c in df.columns],
                            *[features[name].cast("double").alias(name) for name in self.feature_names])

    def save(self, path: str) -> None:
        """Parquet tables below ``path``."""
        spark = self.categories.sparkSession
        rows = [(name, *self.numeric[name]) for name in NUMERIC_FEATURES]
        spark.createDataFrame(rows, NUMERIC_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/numeric_stats")
        self.categories.write.mode("overwrite").parquet(f"{path}/category_map")
        names = spark.createDataFrame([(i, name) for i, name in enumerate(self.feature_names)], "position int, name string")
        names.coalesce(1).write.mode("overwrite").parquet(f"{path}/feature_names")


def _fallback(categories: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """Code of unseen values and how many values there are, by feature; one row per feature is collected."""
    unknown = F.max(F.when(F.col("value") == UNKNOWN, F.col("code")))
    rows = categories.groupBy("feature").agg(F.coalesce(unknown, F.lit(0)).alias("code"), F.count("*").alias("n")).collect()
    return {r["feature"]: r["code"] for r in rows}, {r["feature"]: r["n"] for r in rows}


def _stats(numeric: DataFrame) -> dict[str, tuple[float, float, float]]:
    return {r["feature"]: (r["median"], r["mean"], r["std"]) for r in numeric.collect()}


def fit_numeric(df: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Median, mean and deviation of each numeric feature, learned from ``df``."""
    return _stats(numeric_stats(df))


def scaled(numeric: dict[str, tuple[float, float, float]], df: DataFrame) -> dict[str, Column]:
    """Numeric features filled with the median and standardized, by what ``fit_numeric`` learned."""
    columns = {}
    for name in NUMERIC_FEATURES:
        median, mean, std = numeric[name]
        columns[name] = (F.coalesce(to_number(df, name), F.lit(median)) - F.lit(mean)) / F.lit(std)
    return columns


def fit_features(df: DataFrame) -> FittedFeatures:
    """Learn imputation, scaling and category codes from ``df`` (its training rows).

    The codes are a written table; the driver sees one fallback per feature.
    """
    categories = materialize(category_map(df), "category-map")
    return FittedFeatures(fit_numeric(df), categories, *_fallback(categories))


def load_features(spark: SparkSession, path: str) -> FittedFeatures:
    names = [r["name"] for r in spark.read.parquet(f"{path}/feature_names").orderBy("position").collect()]
    categories = spark.read.schema(CATEGORY_SCHEMA).parquet(f"{path}/category_map")
    numeric = spark.read.schema(NUMERIC_SCHEMA).parquet(f"{path}/numeric_stats")
    return FittedFeatures(_stats(numeric), categories, *_fallback(categories), tuple(names))
