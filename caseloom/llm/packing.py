"""Packing documents into sequences of equal capacity.

How many sequences are needed depends on lengths only, and lengths are numbers
up to the capacity. So lengths are counted, the few counts are packed on the
driver as kinds of sequences with multiplicities, and every piece finds its
place from its length and its rank among the pieces of that length. The plan is
bounded by the capacity, not by the documents.

Kinds: pieces above a third of the capacity meet at most two to a sequence; the
largest is matched with the largest that fits beside it, which matches as many
as can be. Shorter pieces then go, longest first, into the tightest gap left.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import sums_before, utf8
from caseloom.llm.word_tokens import word_tokens
from caseloom.session import materialize

CAPACITY = 2048
# Id put after every document.
END = 0
# Positions of an order that are ranked in one group.
ORDER_ROWS = 4096


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
        order: str | None = None) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32, and ids if asked for.

    ``task`` and ``place`` say which piece of its length it is in the task that
    cut it. ``order`` names a whole number of ``docs`` that its pieces keep as ``position``.
    """
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["position"] * (order is not None) + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = word_tokens(tokenizer_path), TaskContext.get().partitionId()
        places = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            # Few texts at a time: ids of a text are up to four times its size.
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                doc_ids = batch.column("doc_id").to_pylist()
                positions = [()] * len(doc_ids) if order is None else [(p,) for p in batch.column("position").to_pylist()]
                rows: list[tuple] = []
                for doc_id, position, ids in zip(doc_ids, positions, tokens.ids(utf8(batch.column("text")))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * start:4 * (start + capacity)]
                        length = len(own) // 4
                        row = (doc_id, piece, start, length, zlib.crc32(own), task, int(places[length]), *position)
                        places[length] += 1
                        rows.append(row + ((np.frombuffer(own, "<u4").astype(np.int32),) if with_ids else ()))
                columns = list(zip(*rows)) or [()] * len(names)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                         *[pa.int64()] * (order is not None), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, place bigint"
    position = [] if order is None else [F.col(order).cast("bigint").alias("position")]
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *position).mapInArrow(
        run, schema + ", position bigint" * (order is not None) + ", ids array<int>" * with_ids)


# A kind of sequence: runs of (length, times) in order, and how many such sequences there are.
Kind = tuple[tuple[tuple[int, int], ...], int]


def kinds_of(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[Kind]:
    """Kinds of sequences that hold ``counts`` pieces of each length."""
    left = {length: n for length, n in counts.items() if n}
    large = sorted(length for length in left if 3 * length > capacity)
    small = sorted((length for length in left if 3 * length <= capacity), reverse=True)
    # Sequences by the gap they have left; ``gaps`` are the sorted gaps in use.
    by_gap: dict[int, list[Kind]] = {}
    gaps: list[int] = []

    def put(runs: tuple, n: int) -> None:
        gap = capacity - sum(length * times for length, times in runs)
        if n:
            if gap not in by_gap:
                by_gap[gap] = []
                insort(gaps, gap)
            by_gap[gap].append((runs, n))

    while large:
        length = large.pop()
        n = left[length]
        while n:
            # The largest partner still there, the same length included.
            partners = bisect_left(large, capacity - length + 1)
            if 2 * length <= capacity and n > 1:
                put(((length, 2),), n // 2)
                n %= 2
            elif partners:
                other = large[partners - 1]
                pairs = min(n, left[other])
                put(((length, 1), (other, 1)), pairs)
                n -= pairs
                left[other] -= pairs
                if not left[other]:
                    large.pop(partners - 1)
            else:
                put(((length, 1),), n)
                n = 0
    for length in small:
        n = left[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                put(((length, each),), n // each)
                put(((length, n % each),) if n % each else (), 1 if n % each else 0)
                break
            gap = gaps[at]
            runs, sequences = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            each = gap // length
            full = min(sequences, n // each)
            put(runs + ((length, each),), full)
            n -= full * each
            rest = sequences - full
            if rest and n:
                # Fewer than a whole sequence takes.
                put(runs + ((length, n),), 1)
                n, rest = 0, rest - 1
            put(runs, rest)
    return [kind for gap in gaps for kind in by_gap[gap]]


def _slots(kinds: list[Kind]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, sequences of the kind, first sequence, offset), ranks ascending."""
    ranks: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for runs, n in kinds:
        offset = 0
        for length, times in runs:
            rank = ranks.get(length, 0)
            slots.setdefault(length, []).append((rank, n, first, offset))
            ranks[length] = rank + n * times
            offset += length * times
        first += n
    return slots


def _ranked_in_order(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their ``rank`` among those of their length, by position and piece."""
    # Ranks inside runs of positions, added to the sizes of the runs before: no window over a whole length.
    runs = pieces.withColumn("run", F.floor(F.col("position") / F.lit(ORDER_ROWS)))
    offsets = sums_before(runs.groupBy("length", "run").agg(F.count("*").alias("n")), "run", "n", ["length"])
    inside = Window.partitionBy("length", "run").orderBy("position", "piece")
    return (runs.withColumn("place", F.row_number().over(inside) - 1).join(offsets, ["length", "run"])
            .withColumn("rank", F.col("before") + F.col("place")))


def _numbered_in_order(placed: DataFrame) -> DataFrame:
    """``placed`` with ``sequence_id`` numbered by the first (position, piece) of each sequence."""
    firsts = (placed.groupBy("sequence_id").agg(F.min(F.struct("position", "piece")).alias("first"))
              .withColumn("run", F.floor(F.col("first.position") / F.lit(ORDER_ROWS))))
    offsets = sums_before(firsts.groupBy("run").agg(F.count("*").alias("n")), "run", "n")
    inside = Window.partitionBy("run").orderBy("first")
    numbers = (firsts.withColumn("place", F.row_number().over(inside) - 1).join(offsets, "run")
               .select("sequence_id", (F.col("before") + F.col("place")).alias("number")))
    return placed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("number"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
         order: str | None = None) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``, and their ids if asked for.

    A document is the ids of its text and ``END``; only longer ones than the
    capacity are cut. Null text is empty, a piece of one id. doc_id is passed on
    as it is, null or repeated too. Only doc_id and text are read. An empty
    table gives no rows.

    ``order`` names a column of distinct whole numbers from 0: pieces of one
    length take their places by it, and sequences are numbered by the smallest
    they hold. Which lengths meet does not depend on it.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, tokenizer_path, capacity, with_ids, order), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # One row per task and length.
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    # At most ``capacity`` rows.
    counts = {row["length"]: row["n"] for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        list(_slots(kinds_of(counts, capacity)).items()),
        "length bigint, slots array<struct<rank: bigint, n: bigint, first: bigint, offset: bigint>>")
    ranked = _ranked_in_order(pieces) if order is not None else (
        pieces.join(offsets, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place")))
    # Bounded by the capacity, so the table may be broadcast.
    placed = (ranked.join(F.broadcast(slots), "length")
              .withColumn("slot", F.element_at(F.filter("slots", lambda s: s["rank"] <= F.col("rank")), -1))
              .withColumn("beyond", F.col("rank") - F.col("slot.rank"))
              .withColumn("sequence_id", F.col("slot.first") + F.col("beyond") % F.col("slot.n"))
              .withColumn("offset", F.col("slot.offset") + F.floor(F.col("beyond") / F.col("slot.n")) * F.col("length")))
    if order is not None:
        placed = _numbered_in_order(placed)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
                         *(["ids"] if with_ids else []))
