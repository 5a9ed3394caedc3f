"""Importance resampling of documents towards a target distribution.

A feature is a run of one or two words, hashed to a bucket. A bucket's gain is
the log ratio of its shares in the target texts and in all documents, as a whole
number; a document weighs the mean gain of its features; documents are drawn
without replacement by the largest weight plus Gumbel noise of their own.

Weights are summed on bit slices. Slice i of a document has one bit per bucket:
bit i of how often the document holds it. The gains have such slices too, one
for each bit of the positive gains and of the negative ones. A document's sum is
then the sum over slice pairs of 2^(i+j) times the number of ones of their AND,
positive minus negative, in whole numbers throughout.

Bucket counts of the tables are summed per task before they meet, so the driver
sees one number per bucket. Ranks come from range partitions of (score, doc_id),
each numbered by itself after the sizes of those before it, so neither a common
score nor a large table falls to one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import utf8
from caseloom.session import materialize

BUCKETS = 10_000
RUN_WORDS = 2
# Texts whose bucket counts form one block of slices, and bytes of text hashed at once.
BLOCK_TEXTS, BATCH_BYTES = 64, 2 << 20

# A-Z in lower case; every other ASCII byte that is neither letter nor digit parts words.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                    for b in range(256))
# What a byte adds to the state of CRC-32.
_CRC_STEP = np.array([crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)


def _with_blank(crcs: np.ndarray) -> np.ndarray:
    """CRC-32 of the same bytes and a blank."""
    state = ~crcs
    return ~(_CRC_STEP[(state ^ 0x20) & 0xFF] ^ (state >> 8))


def features(texts: list[bytes], run_words: int = RUN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 and text number of every run of up to ``run_words`` words, and each text's number of words."""
    split = [text.translate(_WORD_BYTES).split() for text in texts]
    sizes = np.array([len(words) for words in split], np.int64)
    words = list(chain.from_iterable(split))
    owner = np.repeat(np.arange(len(texts)), sizes)
    crcs = np.fromiter(map(crc32, words), np.uint32, len(words))
    found, owners = [crcs], [owner]
    for more in range(1, min(run_words, len(words))):
        crcs = np.fromiter(map(crc32, words[more:], _with_blank(crcs[:-1]).tolist()), np.uint32, len(words) - more)
        whole = owner[more:] == owner[:-more]
        found.append(crcs[whole])
        owners.append(owner[more:][whole])
    return np.concatenate(found), np.concatenate(owners), sizes


def slices(counts: np.ndarray) -> list[np.ndarray]:
    """Bit slices of rows of whole numbers, lowest first: 64 columns to a word."""
    out, width = [], -(-counts.shape[1] // 64) * 8
    for bit in range(int(counts.max(initial=0)).bit_length()):
        words = np.zeros((len(counts), width), np.uint8)
        packed = np.packbits(((counts >> bit) & 1).astype(np.uint8), axis=1)
        words[:, :packed.shape[1]] = packed
        out.append(words.view(np.uint64))
    return out


def gain_slices(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, slice) of the positive and of the negative gains."""
    return [(sign << bit, part[0]) for sign in (1, -1)
            for bit, part in enumerate(slices(np.maximum(sign * gains, 0)[None, :]))]


def sums(counts: np.ndarray, gains: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Exact sum of count times gain for each row of ``counts``."""
    total = np.zeros(len(counts), np.int64)
    most = counts.max(axis=1, initial=0)
    for bit, part in enumerate(slices(counts)):
        rows = np.flatnonzero(most >> bit)
        for power, gain in gains:
            total[rows] += (power << bit) * np.bitwise_count(part[rows] & gain).sum(axis=1, dtype=np.int64)
    return total


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of few texts and few bytes; a longer text comes alone."""
    for whole in batches:
        texts = utf8(whole.column("text"))
        start = size = 0
        for i, text in enumerate(texts):
            if i > start and (size + len(text) > BATCH_BYTES or i - start == BLOCK_TEXTS):
                yield whole.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(text)
        if start < len(texts):
            yield whole.slice(start), texts[start:]


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, run_words: int = RUN_WORDS) -> np.ndarray:
    """How often each bucket's features occur in the column ``text`` of all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, texts in _batches(batches):
            counts += np.bincount(features(texts, run_words)[0] % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["bucket", "n"])

    by_bucket = (rows.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
                 .groupBy("bucket").agg(F.sum("n").alias("n")))
    counts = np.zeros(buckets, np.int64)
    # One row per bucket.
    for row in by_bucket.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def log_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    smooth, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_source + smooth) / (float(s + 1) * float(all_target + smooth))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, ``n_words``, ``n_features`` and ``weight``, the mean gain rounded down (0 without features)."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = gain_slices(gains)
        for batch, texts in _batches(batches):
            crcs, owners, words = features(texts, run_words)
            n = np.bincount(owners, minlength=len(texts))
            counts = np.bincount(owners * buckets + crcs % np.uint32(buckets), minlength=len(texts) * buckets)
            weight = sums(counts.reshape(len(texts), buckets), planes) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (words, n, weight)]],
                ["doc_id", "n_words", "n_features", "weight"])

    return (docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of the key."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    drawn = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, buckets: int = BUCKETS,
             run_words: int = RUN_WORDS, seed: int = 7) -> DataFrame:
    """Every document's doc_id, ``n_features``, ``weight``, ``score`` and, if drawn, ``rank``.

    Of the N documents with ``least_words`` words or more, floor(percent * N / 100)
    are drawn by score, ties by the smaller doc_id; others have no rank. Null
    text has no words; without features a document weighs 0. Null doc_ids come
    last among ties and draw one noise, as repeated doc_ids do; rows that tie in
    both go by weight, then by n_features. Of ``docs`` only doc_id and text, of
    ``target`` only text is read. An empty target gives every bucket the same
    smoothed share; an empty table gives no rows.
    """
    gains = log_gains(bucket_counts(docs, buckets, run_words), bucket_counts(target, buckets, run_words))
    scored = materialize(weigh(docs, gains, run_words).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")]
    # Written, for a second sampling of the ranges need not give the same ones.
    ranged = materialize(scored.where(F.col("n_words") >= least_words).repartitionByRange(*order)
                         .withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    # One row per range, that is per partition.
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("range", (F.sum("n").over(upto) - F.col("n")).alias("before"),
                           F.floor(F.sum("n").over(Window.partitionBy()) * F.lit(percent) / 100).alias("drawn"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = (ranged.join(F.broadcast(offsets), "range").withColumn("place", place)
              .withColumn("rank", F.when(F.col("place") <= F.col("drawn"), F.col("place"))))
    columns = ["doc_id", "n_features", "weight", "score"]
    left = scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(left)


def resample_sql() -> str:
    """The query's rows; CRC-32 is folded byte by byte over every distinct feature."""
    capitals, smalls = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH steps AS (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS step
    FROM (SELECT unnest(range(256)) AS i)
), crc AS (
    SELECT list(step ORDER BY i) AS crc FROM steps
), texts AS (
    SELECT 'd' AS side, row_number() OVER () AS row_id, doc_id, text FROM documents
    UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark
), words AS (
    SELECT side, row_id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{capitals}', '{smalls}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM texts
), found AS (
    SELECT side, row_id, unnest(words) AS feature FROM words
    UNION ALL
    SELECT side, row_id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM words
), counted AS (
    SELECT side, row_id, feature, count(*) AS n FROM found GROUP BY ALL
), bytes AS (
    SELECT feature, hex(encode(feature)) AS digits FROM (SELECT DISTINCT feature FROM counted)
), hashed AS (
    SELECT feature, xor(list_reduce(
               list_concat([4294967295], list_transform(range(1, len(digits), 2), lambda i: ('0x' || digits[i:i + 1])::BIGINT)),
               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM bytes, crc
), by_bucket AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t
    FROM counted JOIN hashed USING (feature) GROUP BY bucket
), totals AS (
    SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM by_bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE
                                   / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
    FROM by_bucket, totals
), summed AS (
    SELECT row_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total
    FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row_id
), weighed AS (
    SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
           coalesce(floor(total::DOUBLE / n_features), 0)::BIGINT AS weight
    FROM words LEFT JOIN summed USING (row_id) WHERE side = 'd'
), scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE)
                                           / 4294967296::DOUBLE)))::BIGINT AS score
    FROM weighed
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight DESC, n_features DESC) AS place,
           count(*) OVER (PARTITION BY n_words >= 20) AS eligible
    FROM scored
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END::BIGINT AS rank
FROM placed
"""
