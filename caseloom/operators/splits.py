"""Splits and folds that do not depend on how rows are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.hashing import FOLD_SALT, SPLIT_SALT, percent_bucket
from caseloom.operators.ranking import number_rows


def train_flag(df: DataFrame, key: str = "primaryid", percent: int = 80, salt: int = SPLIT_SALT) -> DataFrame:
    """Add ``is_train``; another salt gives an independent split."""
    return df.withColumn("is_train", (percent_bucket(F.col(key), salt) < percent).cast("int"))


def split(df: DataFrame, key: str = "primaryid", percent: int = 80,
          salt: int = SPLIT_SALT) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows."""
    bucket = percent_bucket(F.col(key), salt)
    return df.where(bucket < percent), df.where(bucket >= percent)


def stratified_folds(df: DataFrame, label: str = "serious", key: str = "primaryid",
                     folds: int = 5, salt: int = FOLD_SALT) -> DataFrame:
    """Add ``fold`` 0..folds-1; each class is dealt out evenly."""
    numbered = number_rows(df, key, salt, by=label)
    return numbered.withColumn("fold", ((F.col("row_no") - 1) % folds).cast("int")).drop("row_no")
