"""A hash both Spark and any other SQL engine can compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers that act as independent salts. Changing the addend
# instead would only shift the sequence.
SPLIT_SALT = 1103515245
FOLD_SALT = 1664525
NOISE_SALT = 22695477

HASH_RANGE = 2147483648
BUCKET_WIDTH = 21474837


def portable_hash(key: Column, salt: int = SPLIT_SALT) -> Column:
    """bigint in [0, 2**31); bigint arithmetic only, no overflow for any key. A null key hashes like 0."""
    reduced = F.pmod(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")), F.lit(2147483647).cast("bigint"))
    return (reduced * F.lit(salt).cast("bigint") + F.lit(12345).cast("bigint")) % F.lit(HASH_RANGE).cast("bigint")


def percent_bucket(key: Column, salt: int = SPLIT_SALT) -> Column:
    """Bucket 0..99 from the high bits; the low bits of the hash are not random."""
    return F.floor(portable_hash(key, salt) / F.lit(BUCKET_WIDTH)).cast("int")


def uniform(key: Column, salt: int = NOISE_SALT) -> Column:
    """double in [0, 1)."""
    return portable_hash(key, salt) / F.lit(float(HASH_RANGE))
