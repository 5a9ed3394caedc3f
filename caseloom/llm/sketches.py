"""Document fingerprints: bottom-k sketches of word shingles.

The sketch of a text is the ``SIZE`` smallest distinct hashes of its shingles of
five words. The sketch of several parts is the smallest of their sketches'
hashes together. From two sketches follow the resemblance of their texts (the
share of the union's smallest hashes that both hold), how far one is contained
in the other, and from one the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import hashes, rolled, words_of

# Hashes of a sketch; the standard error of a resemblance is at most 1 / (2 sqrt(SIZE)).
SIZE = 128
SHINGLE_WORDS = 5


def sketch(text: bytes, size: int = SIZE, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Ascending hashes. A text of fewer words is one shingle; one without words has an empty sketch."""
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    found = rolled(hashes(words, len(words)), min(shingle_words, len(words)))
    if len(found) > 4 * size:
        # Repeated shingles may leave too few distinct ones among these.
        some = np.unique(np.partition(found, 2 * size)[:2 * size])
        if len(some) >= size:
            return some[:size]
    return np.unique(found)[:size]


def merged(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Sketch of two parts together."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of common shingles among all; two empty texts are alike."""
    union = merged(a, b, size)
    if not len(union):
        return 1.0
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def distinct_shingles(a: np.ndarray, size: int = SIZE) -> float:
    """Number of distinct shingles; exact below ``size``."""
    return float(len(a)) if len(a) < size else (size - 1) / (float(a[size - 1]) / 2.0 ** 64)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Share of the shingles of ``a`` that ``b`` holds; an empty text is contained in any."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return min(1.0, shared / distinct_shingles(a, size))


def as_string(a: np.ndarray) -> str:
    """16 hex digits per hash, ascending."""
    return a.astype(">u8").tobytes().hex()


def of_string(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(np.uint64)


def of_groups(docs: DataFrame, by: str, size: int = SIZE) -> DataFrame:
    """``by`` and ``hashes``, the sketch of all texts of each group.

    Tasks merge their texts' sketches first, so a hot group sends ``size`` rows
    per task and group; the window keeps as many per group before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: dict[str | None, np.ndarray] = {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sketch((text or "").encode(), size)
                kept[key] = merged(kept[key], own, size) if key in kept else own
            keys = [key for key, own in kept.items() for _ in own]
            values = np.concatenate([np.empty(0, np.uint64), *kept.values()])
            # Signed numbers in the order of the unsigned ones.
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array((values ^ np.uint64(1 << 63)).view(np.int64))], ["key", "hash"])

    smallest = Window.partitionBy("key").orderBy("hash")
    rows = (docs.select(F.col(by).cast("string"), F.col("text").cast("string")).mapInArrow(run, "key string, hash bigint")
            .distinct().withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= size))
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(
        F.struct("place", F.lpad(F.hex(F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0").alias("hash")))).alias("all")
    ).select(F.col("key").alias(by), F.lower(F.array_join(F.col("all.hash"), "")).alias("hashes"))


_COLUMNS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, distinct_shingles double, kept_in_edited double")
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]


def _edited(doc_id: int | None, text: str, following: str, own: np.ndarray, following_sketch: np.ndarray) -> tuple:
    cut = len(text) // 3
    edited = (text[:len(text) - cut] + following[:cut]).encode()
    changed = sketch(edited)
    return (doc_id, len(text), hashlib.sha256(edited).hexdigest(), as_string(own), as_string(changed),
            resemblance(own, changed), resemblance(own, following_sketch), distinct_shingles(own),
            containment(own, changed))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row with the next one of its range; rows come sorted, a range's last one is a guest."""
    last = None
    for whole in batches:
        for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            rows = []
            for part, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("part", "doc_id", "text"))):
                own = (doc_id, text, sketch(text.encode()))
                if last is not None and last[0] == part:
                    rows.append(_edited(*last[1][:2], text, last[1][2], own[2]))
                last = (part, own)
            yield _batch(rows)


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            own = sketch(text.encode())
            rows.append(_edited(None, text, text, own, own))
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, _KINDS)], _NAMES)


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at least ``value``, by coarse and fine search."""
    stride = max(1, round(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(c) for c in cuts[stride - 1::stride]]).cast("array<bigint>")
    below = F.size(F.filter(coarse, lambda c: c < value)) * stride
    fine = F.slice(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), below + 1, stride)
    return F.lit(len(cuts)) - below - F.size(F.filter(fine, lambda c: c < value))


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its text with the last third taken from the next document.

    The next document is the one before it by doc_id, and the largest for the
    smallest. doc_ids are cut into ranges at their quantiles, four for each
    shuffle partition. The first document of a range also goes to the range
    before as a guest, so texts move once and every pair meets in one task. Null
    text is empty. Rows that share a doc_id follow each other by text; a row
    without one is its own next. Only doc_id and text are read. A table of one
    row is its own next; an empty one gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = texts.where("doc_id is not null")
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # What the driver sees is bounded by the shuffle partitions: cut points and one id for each range.
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = sorted(set(named.agg(F.percentile_approx("doc_id", shares, F.lit(20 * ranges))).first()[0] or [0]))
    part = _range_of(F.col("doc_id"), cuts)
    heads = sorted((row["part"], row["head"]) for row in
                   named.groupBy(part.alias("part")).agg(F.max("doc_id").alias("head")).collect())
    following = [(heads[(i + 1) % len(heads)][1], number) for i, (number, _) in enumerate(heads)]
    visits = spark.createDataFrame(following, "doc_id bigint, part int")
    guests = (named.join(F.broadcast(visits), "doc_id").groupBy("part").agg(F.min(F.struct("text", "doc_id")).alias("row"))
              .select("part", F.lit(1).alias("guest"), "row.doc_id", "row.text"))
    rows = named.select(part.alias("part"), F.lit(0).alias("guest"), "doc_id", "text").unionByName(guests)
    walked = (rows.repartition("part").sortWithinPartitions("part", "guest", F.col("doc_id").desc(), "text")
              .mapInArrow(_walk, _COLUMNS))
    return walked.unionByName(texts.where("doc_id is null").mapInArrow(_alone, _COLUMNS))
