"""Numeric coercion and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a number in a text field.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a finite double; bad text, NaN, infinities or no such column give null."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    source = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        # Spark's cast also takes "1d" and "1f", so the pattern decides first.
        source = F.when(source.rlike(NUMBER_PATTERN), F.trim(source))
    number = source.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, 0 for an empty denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def at_least(score: Column, threshold: float = 0.5) -> Column:
    """Class 1 when the score reaches the threshold."""
    return (score >= F.lit(float(threshold))).cast("int")
