"""Synthetic case table for demonstrations and tests.

Every value is a function of the row number and the seed, so the table is the
same however it is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.config import (DEMO_CHALLENGE, DEMO_COUNTRIES, DEMO_DOSES, DEMO_DRUGS, DEMO_FREQUENCIES,
                             DEMO_REACTIONS, DEMO_ROUTES, SEED, VALUE_SEPARATOR)
from caseloom.operators.statistics import risk_score
from caseloom.sources.sinks import write_csv


def demo_cases(spark: SparkSession, n: int = 10_000, seed: int = SEED, save_to: str | None = None) -> DataFrame:
    """``n`` cases with 16 inputs and the rule-based label; written as CSV if ``save_to`` is given."""
    key = F.col("primaryid")

    def draw(name: str) -> Column:
        """Uniform in [0, 1), independent per column name."""
        return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(name)), 11) * F.lit(2.0 ** -53)

    def normal(name: str, mean: float, deviation: float) -> Column:
        radius = F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - draw(f"{name}/radius")))
        return F.lit(mean) + F.lit(deviation) * radius * F.cos(F.lit(6.283185307179586) * draw(f"{name}/angle"))

    def clipped(value: Column, low: float, high: float) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), value))

    def whole(name: str, low: int, count: int) -> Column:
        return (F.lit(low) + F.floor(draw(name) * count)).cast("int")

    def choice(name: str, values: Sequence) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), whole(name, 1, len(values)))

    sex = F.when(draw("sex") < 0.45, "M").when(draw("sex") < 0.9, "F").otherwise("UNK")
    # Shuffled by a per-row order, then cut: draws without replacement.
    shuffled = F.array_sort(F.array(*[F.struct(draw(f"reaction/{r}").alias("order"), F.lit(r).alias("name"))
                                      for r in DEMO_REACTIONS]))
    chosen = F.slice(shuffled, F.lit(1), whole("reactions", 1, 3))
    cases = spark.range(n).withColumnRenamed("id", "primaryid").select(
        key,
        clipped(normal("age", 55, 18), 1, 100).cast("int").alias("age"),
        sex.alias("sex"),
        clipped(normal("wt", 75, 20), 30.0, 200.0).alias("wt"),
        choice("occr_country", DEMO_COUNTRIES).alias("occr_country"),
        whole("drug_seq", 1, 9).alias("drug_seq"),
        choice("dose_amt", DEMO_DOSES).alias("dose_amt"),
        choice("dose_freq", DEMO_FREQUENCIES).alias("dose_freq"),
        whole("dur", 1, 364).alias("dur"),
        choice("dechal", DEMO_CHALLENGE).alias("dechal"),
        choice("rechal", DEMO_CHALLENGE).alias("rechal"),
        choice("drugname", DEMO_DRUGS).alias("drugname"),
        choice("route", DEMO_ROUTES).alias("route"),
        choice("prod_ai", DEMO_DRUGS).alias("prod_ai"),
        F.array_join(F.transform(chosen, lambda c: c["name"]), VALUE_SEPARATOR).alias("reactions"),
        F.lit("demo").alias("quarter"),
        (draw("noise") * 0.3).alias("_noise"),
    )
    score = risk_score(F.col("age"), F.col("drug_seq"), F.col("reactions"), F.col("_noise"))
    cases = cases.withColumn("serious", (score > 0.5).cast("int")).drop("_noise")
    if save_to:
        write_csv(cases, save_to)
    return cases
