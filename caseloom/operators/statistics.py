"""Descriptive statistics of a case table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.config import RISK_POINTS
from caseloom.functions.hashing import uniform
from caseloom.functions.numbers import to_number
from caseloom.functions.text import risky_reaction
from caseloom.operators.quantilesketch import quantiles, sketch
from caseloom.operators.ranking import frequency_table, quantiles_of

# Age bands, open below and closed above.
AGE_BANDS = [(0, 18, "<18"), (18, 40, "18-40"), (40, 65, "40-65"), (65, 100, "65+")]
BINS = 30
CORRELATED = ["age", "wt", "drug_seq", "dose_amt", "dur", "serious"]


def risk_score(age: Column, drug_seq: Column, reactions: Column, noise: Column) -> Column:
    """Rule behind the synthetic label; ``noise`` is in [0, 0.3)."""

    def points(condition: Column, weight: float) -> Column:
        return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))

    return (points(age > 65, RISK_POINTS["age"]) + points(drug_seq > 5, RISK_POINTS["drugs"])
            + points(risky_reaction(reactions), RISK_POINTS["reaction"]) + noise)


def with_risk_label(cases: DataFrame) -> DataFrame:
    """Replace ``serious`` by the risk rule, with noise that depends on the case key only."""
    score = risk_score(to_number(cases, "age"), to_number(cases, "drug_seq"), F.col("reactions"),
                       uniform(F.col("primaryid")) * F.lit(RISK_POINTS["noise"]))
    return cases.withColumn("serious", (score > 0.5).cast("int"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values; ties go by value."""
    return value_counts(df, column).orderBy(F.desc("n"), column).limit(k)


def class_share(df: DataFrame, label: str = "serious") -> DataFrame:
    """Rows and percentage per class, with the class name."""
    counts = value_counts(df, label)
    total = counts.agg(F.sum("n")).scalar()
    name = F.when(F.col(label) == 1, "Serious").otherwise("Non-Serious")
    return counts.select(label, name.alias("class_name"), "n", (F.lit(100.0) * F.col("n") / total).alias("percent"))


def overall_rate(df: DataFrame, label: str = "serious") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.avg(label).alias("serious_rate"))


def rate_by(df: DataFrame, column: str, label: str = "serious") -> DataFrame:
    """Label mean per value; null values form no group."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(column).agg(F.count("*").alias("n"), F.avg(label).alias("serious_rate")))


def top_rates(df: DataFrame, column: str, label: str = "serious", k: int = 10) -> DataFrame:
    """The k values with the highest label mean; ties go by value."""
    return rate_by(df, column, label).orderBy(F.desc("serious_rate"), column).limit(k)


def age_band(age: Column) -> Column:
    """Right-closed age band; null outside (0, 100]."""
    band = F.lit(None).cast("string")
    for low, high, name in reversed(AGE_BANDS):
        band = F.when((age > low) & (age <= high), F.lit(name)).otherwise(band)
    return band


def rate_by_age_band(df: DataFrame, label: str = "serious") -> DataFrame:
    return rate_by(df.select(age_band(to_number(df, "age")).alias("age_band"), label), "age_band", label)


def crosstab(df: DataFrame, column: str = "sex", label: str = "serious") -> DataFrame:
    """Rows per value and class; the classes are known, so no job looks for them."""
    table = df.where(F.col(column).isNotNull()).groupBy(column).pivot(label, [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    return table.select(column, F.col("0").alias("non_serious"), F.col("1").alias("serious"))


def histogram(df: DataFrame, value: str, by: str = "serious", bins: int = BINS) -> DataFrame:
    """Equal-width bins over each class's own range, the last one closed; empty bins count 0.

    ``by`` is a class column with few values. Texts that are no numbers are left out.
    """
    rows = df.where(F.col(by).isNotNull()).select(by, to_number(df, value).alias("x")).where("x is not null")
    spans = rows.groupBy(by).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    # A constant column gets a range of width one around its value.
    flat = F.col("low") == F.col("high")
    spans = spans.select(by, F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
                         F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    lookup = F.map_from_entries(F.collect_list(F.struct(by, F.struct("low", "high"))))
    span = F.element_at(spans.agg(lookup).scalar(), F.col(by))
    rows = rows.withColumn("_span", span)
    low, high = F.col("_span.low"), F.col("_span.high")
    step = (high - low) / bins
    guess = F.least(F.floor((F.col("x") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    rows = rows.withColumn("_guess", guess)
    # The division can miss an edge by one rounding; the edges themselves decide.
    exact = (F.when(F.col("x") < low + F.col("_guess") * step, F.col("_guess") - 1)
             .when((F.col("_guess") < bins - 1) & (F.col("x") >= low + (F.col("_guess") + 1) * step),
                   F.col("_guess") + 1)
             .otherwise(F.col("_guess")))
    counts = rows.select(by, exact.alias("bin")).groupBy(by, "bin").agg(F.count("*").alias("n"))
    frame = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("high") - F.col("low")) / bins
    return (frame.join(counts, [by, "bin"], "left")
            .select(by, "bin", (F.col("low") + F.col("bin") * width).alias("bin_low"),
                    (F.col("low") + (F.col("bin") + 1) * width).alias("bin_high"),
                    F.coalesce("n", F.lit(0)).alias("n")))


def _boxes(df: DataFrame, value: str, by: str, error: float | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Frequencies of the values, one box per class, and the test for lying within its fences.

    All of it starts from the frequencies, so the table itself is read once.
    """
    rows = df.where(F.col(by).isNotNull()).select(by, to_number(df, value).alias("x"))
    frequencies = frequency_table(rows, "x", by)
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[2]
    spread = (q3 - q1) * 1.5
    shares = [0.25, 0.5, 0.75]
    found = quantiles_of(frequencies, "x", shares, by) if error is None else quantiles(
        sketch(frequencies, "x", error, [by], "_n"), shares, error, [by])
    boxes = found.select(
        by, "n", q1.alias("q1"), F.col("quantiles")[1].alias("median"), q3.alias("q3"),
        (q1 - spread).alias("low"), (q3 + spread).alias("high"))
    lookup = F.map_from_entries(F.collect_list(F.struct(by, F.struct("low", "high"))))
    fenced = frequencies.withColumn("_fence", F.element_at(boxes.agg(lookup).scalar(), F.col(by)))
    return fenced, boxes, (F.col("x") >= F.col("_fence.low")) & (F.col("x") <= F.col("_fence.high"))


def boxplot(df: DataFrame, value: str = "dose_amt", by: str = "serious", error: float | None = None) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 interquartile ranges, outlier count.

    ``by`` is a class column with few values. ``error`` takes the quartiles from
    a sketch, values of the table to that relative error.
    """
    fenced, boxes, inside = _boxes(df, value, by, error)
    outliers = F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0))
    ends = fenced.groupBy(by).agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
                                  F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
                                  outliers.alias("n_outliers"))
    # A whisker never ends inside the box.
    return boxes.join(ends, by).select(
        by, "n", "q1", "median", "q3", F.least("whisker_low", "q1").alias("whisker_low"),
        F.greatest("whisker_high", "q3").alias("whisker_high"), "n_outliers")


def boxplot_outliers(df: DataFrame, value: str = "dose_amt", by: str = "serious") -> DataFrame:
    """Values beyond the whiskers with their frequency; ``by`` is a class column with few values."""
    fenced, _, inside = _boxes(df, value, by)
    return fenced.where(~inside).select(by, F.col("x").alias("outlier"), F.col("_n").alias("n"))


def correlation_matrix(df: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson correlation of every pair over the rows where both are present.

    One pass over the table, whose moments fold to one row per task before the
    shuffle; a constant column gives null.
    """
    numbers = df.select(*[to_number(df, c).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    # Each leaves rows without both values out by itself, and is merged without loss of precision.
    moments = [moment(b, a).alias(f"{kind}_{a}_{b}") for a, b in pairs
               for kind, moment in (("sxy", F.regr_sxy), ("sxx", F.regr_sxx), ("syy", F.regr_syy))]
    row = numbers.agg(*moments)
    both_ways = [(a, b, f"{a}_{b}") for a, b in pairs] + [(b, a, f"{a}_{b}") for a, b in pairs if a != b]
    lines = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                      F.try_divide(F.col(f"sxy_{pair}"), F.sqrt(f"sxx_{pair}") * F.sqrt(f"syy_{pair}")).alias("correlation"))
             for a, b, pair in both_ways]
    return row.select(F.inline(F.array(*lines)))


def preview(df: DataFrame, n: int = 5, key: str = "primaryid") -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(n)


def row_counts(df: DataFrame) -> DataFrame:
    """Rows per quarter and in total."""
    return (df.rollup("quarter").agg(F.count("*").alias("n"), F.grouping("quarter").alias("_all"))
            .select(F.when(F.col("_all") == 1, F.lit("total")).otherwise(F.col("quarter")).alias("quarter"), "n"))
