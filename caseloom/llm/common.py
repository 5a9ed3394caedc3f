"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, so that no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes, lower: bool = False) -> list[bytes]:
    """Runs of bytes other than blank and 09-0D, which is what ``bytes.split`` cuts at."""
    return (text.lower() if lower else text).split()


def hashes(items: Iterable[bytes], count: int) -> np.ndarray:
    """XXH64 of each item, as unsigned 64-bit numbers."""
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(SEED)), np.uint64, count=count)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's finaliser)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def rolled(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words; empty if there are fewer."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i:i + n]
    return mixed(total)


def per_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator], Iterator]:
    """``work`` as the function ``mapInArrow`` wants."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield work(batch)
    return run


def sums_before(sizes: DataFrame, order: str, size: str, by: list[str] | None = None, block: int = 4096) -> DataFrame:
    """``by``, ``order`` and ``before``, the sum of ``size`` over rows earlier in ``order``, a whole number from 0.

    ``sizes`` has one row per (by, order). Sums go in two steps, over blocks of
    ``block`` numbers and inside each, so that no window holds more than the
    blocks of one group.
    """
    by = by or []
    rows = sizes.select(*by, order, size).withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy(*by, "_block").agg(F.sum(size).alias("_size"))
              .select(*by, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_upto")))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_in", F.coalesce(F.sum(size).over(inside), F.lit(0))).join(blocks, [*by, "_block"])
            .select(*by, order, (F.col("_upto") + F.col("_in")).alias("before")))
