"""Packing documents into windows by non-negative least squares.

Documents are cut at the window size, which leaves at most one shorter piece of
each. How often each length occurs is a histogram no longer than a window. Every
combination of at most three lengths that fills a window exactly is a column;
non-negative least squares finds how often to repeat which columns so that they
use up the histogram. Repeats are rounded to what the histogram still holds, and
exact pairs and triples are taken greedily from what is left.

Lengths that then remain make one stream, longest first, which is cut at every
window, so no window is padded. The end of the stream, shorter than a window, is
cut into powers of two. The plan is made from the histogram alone, on the
driver; every piece finds its place from its length and its rank among the
pieces of that length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import utf8
from caseloom.llm.word_tokens import word_tokens
from caseloom.session import materialize

CAPACITY = 2048
# Id put after every document.
END = 1
# Texts tokenized at a time.
TEXTS = 256
# Solver: rounds of new columns, columns a round, steps a round, and the largest gradient that counts as none.
ROUNDS, COLUMNS, STEPS, TOLERANCE = 60, 400, 200, 1e-4

# Lengths of a kind of sequence, longest first, and how many such sequences there are.
Kind = tuple[tuple[int, ...], int]


def combinations(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three of the ``lengths``, descending and 0 for none, that sum to ``capacity``."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = there[0] = True
    rows = []
    for longest in range(capacity, (capacity - 1) // 3, -1):
        if there[longest]:
            rest = capacity - longest
            second = np.arange(-(-rest // 2), min(longest, rest) + 1)
            second = second[there[second] & there[rest - second]]
            rows.append(np.stack([np.full(len(second), longest), second, rest - second], axis=1))
    return np.concatenate(rows) if rows else np.empty((0, 3), np.int64)


def least_squares(columns: np.ndarray, wanted: np.ndarray, weights: np.ndarray, rounds: int = ROUNDS,
                  tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Columns in use and their repeats x >= 0 that bring the weighted use of lengths nearest to ``wanted``.

    A working set grows by the columns of steepest descent that share no length;
    accelerated projected gradients solve it. It ends when no column descends by
    more than ``tolerance`` of the first steepest, or after ``rounds``.
    """
    square = weights ** 2
    square[0] = 0
    norms = np.sqrt(square[columns].sum(axis=1))
    chosen, repeats = np.empty(0, np.int64), np.empty(0)
    steepest = None

    def left_by(which: np.ndarray, x: np.ndarray) -> np.ndarray:
        return wanted - np.bincount(columns[which].ravel(), np.repeat(x, 3), minlength=len(wanted))

    for _ in range(rounds):
        slope = (square * left_by(chosen, repeats))[columns].sum(axis=1) / norms
        slope[chosen] = 0
        steepest = steepest or max(float(slope.max(initial=0)), 1e-12)
        best = np.argsort(-slope, kind="stable")[:8 * COLUMNS]
        used, fresh = np.zeros(len(wanted), bool), []
        for column in best[slope[best] > tolerance * steepest].tolist():
            parts = columns[column][columns[column] > 0]
            if not used[parts].any():
                used[parts] = True
                fresh.append(column)
                if len(fresh) == COLUMNS:
                    break
        if not fresh:
            break
        # The rounds before settle the repeats; a column that fell to none leaves.
        kept = repeats > 0
        chosen = np.concatenate([chosen[kept], np.array(fresh, np.int64)])
        repeats = np.concatenate([repeats[kept], np.zeros(len(fresh))])
        repeats = _descend(columns[chosen], wanted, square, repeats)
    return chosen, repeats


def _descend(parts: np.ndarray, wanted: np.ndarray, square: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Accelerated projected gradient steps for the columns ``parts``, in the scale of their norms."""
    scale = 1 / np.sqrt(square[parts].sum(axis=1))
    flat, size = parts.ravel(), len(wanted)

    def use(y: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(y * scale, 3), minlength=size)

    # The largest eigenvalue, by power iteration, bounds the step.
    probe = np.ones(len(x))
    for _ in range(12):
        probe = (square * use(probe))[parts].sum(axis=1) * scale
        largest = np.linalg.norm(probe)
        probe /= largest
    step = 1 / (1.05 * largest)
    x = ahead = x / scale
    momentum = 1.0
    for _ in range(STEPS):
        moved = np.maximum(ahead + step * (square * (wanted - use(ahead)))[parts].sum(axis=1) * scale, 0)
        following = (1 + (1 + 4 * momentum ** 2) ** 0.5) / 2
        # Momentum that leads uphill starts anew.
        if ((ahead - moved) * (moved - x)).sum() > 0:
            following = 1.0
            ahead = moved
        else:
            ahead = moved + (momentum - 1) / following * (moved - x)
        x, momentum = moved, following
    return x * scale


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[Kind], dict[int, int]]:
    """Kinds of sequences that are full, and the pieces of each length that are left for the stream."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    kinds: list[Kind] = []

    def take(parts: tuple[int, ...], most: int) -> None:
        lengths, times = np.unique(parts, return_counts=True)
        n = min(most, int((left[lengths] // times).min()))
        if n > 0:
            left[lengths] -= n * times
            kinds.append((parts, n))

    if left[capacity]:
        take((capacity,), int(left[capacity]))
    columns = combinations(np.flatnonzero(left), capacity)
    if len(columns):
        # A long piece that is left costs more than a short one.
        weights = np.sqrt(np.arange(capacity + 1) / capacity)
        chosen, repeats = least_squares(columns, left.astype(float), weights)
        for i in np.lexsort((chosen, -repeats)).tolist():
            take(tuple(c for c in columns[chosen[i]].tolist() if c), round(repeats[i]))
    for longest in range(capacity - 1, 0, -1):
        rest = capacity - longest
        while left[longest]:
            left[longest] -= 1
            second = np.arange(-(-rest // 2), min(longest, rest) + 1)
            third = rest - second
            there = np.where(third == 0, left[second], np.minimum(left[second], left[third]))
            there[(second == third) & (left[second] < 2)] = 0
            best = int(there.argmax()) if len(there) else 0
            left[longest] += 1
            if not len(there) or not there[best]:
                break
            take(tuple(c for c in (longest, int(second[best]), int(third[best])) if c), int(left[longest]))
    return kinds, {int(length): int(left[length]) for length in np.flatnonzero(left)}


def powers_of_two(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << bit for bit in range(n.bit_length() - 1, -1, -1) if n >> bit & 1]


def places(kinds: list[Kind], stream: Mapping[int, int], capacity: int) -> tuple[list[tuple], int, list[int]]:
    """(length, slots, used, stream place) of every length, the sequences before the stream's, and the stream's ends.

    A slot is (first rank, sequences, first sequence, offset), ranks ascending;
    ranks from ``used`` on go to the stream. The ends are those of the sequences
    behind its last whole window.
    """
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for parts, n in kinds:
        offset = 0
        for length in parts:
            slots.setdefault(length, []).append((used.get(length, 0), n, first, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first += n
    at: dict[int, int] = {}
    total = 0
    for length in sorted(stream, reverse=True):
        at[length] = total
        total += length * stream[length]
    ends = np.cumsum([total - total % capacity, *powers_of_two(total % capacity)]).tolist()
    rows = [(length, slots.get(length, []), used.get(length, 0), at.get(length, 0)) for length in sorted({*slots, *at})]
    return rows, first, ends


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, doc_tokens, ids_crc32, ids (little-endian, unsigned 32 bits).

    ``task`` and ``place`` say which piece of its length it is in the task that
    cut it. Whole windows are never cut again and go without ids unless ``with_ids``.
    """
    tail = np.array([end], "<u4").tobytes()
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.int64()]
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids", "task", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = word_tokens(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for whole in batches:
            # Few texts at a time: ids of a text are up to four times its size.
            for batch in (whole.slice(i, TEXTS) for i in range(0, whole.num_rows, TEXTS)):
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), tokens.ids(utf8(batch.column("text")))):
                    ids += tail
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        own = ids[4 * start:4 * (start + length)]
                        rows.append((doc_id, start, length, n, zlib.crc32(own), own if with_ids or length < capacity else None,
                                     task, int(seen[length])))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary, task int, place bigint")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    A document is the ids of its text and ``end``; null text is empty, a document
    of one id. All sequences are ``capacity`` ids long but the last few, which
    have powers of two, so none is padded. doc_id is passed on as it is, null or
    repeated too; every row is a document of its own. Only doc_id and text are
    read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = materialize(cut(docs, tokenizer_path, capacity, end, with_ids), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # One row per task and length.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # At most ``capacity`` rows.
    counts = {row["length"]: row["n"] for row in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, sequences, ends = places(*plan(counts, capacity), capacity)
    table = spark.createDataFrame(
        rows, "length bigint, slots array<struct<rank: bigint, n: bigint, first: bigint, offset: bigint>>, used bigint, at bigint")
    # Bounded by the capacity, so the table may be broadcast.
    ranked = (pieces.join(offsets, ["task", "length"]).join(F.broadcast(table), "length")
              .withColumn("rank", F.col("before") + F.col("place")))

    whole_windows, last = ends[0] // capacity, F.array(*[F.lit(e) for e in ends])
    slot = F.try_element_at(F.filter("slots", lambda s: s["rank"] <= F.col("rank")), F.lit(-1))
    position = F.col("at") + (F.col("rank") - F.col("used")) * F.col("length")
    # Borders of stream sequences inside a piece: one window's, and at the end those of the powers of two.
    window_end = (F.floor(F.col("position") / capacity) + 1) * capacity
    borders = F.filter(F.array_distinct(F.concat(F.array(window_end), last)),
                       lambda b: (b > F.col("position")) & (b < F.col("position") + F.col("length"))
                       & ((b <= ends[0]) | F.array_contains(last, b)))
    cuts = F.array_sort(F.concat(F.array(F.col("position")), borders))
    # A piece outside the stream has one part.
    parts = F.when(F.col("rank") < F.col("used"), F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(cuts, lambda c: c - F.col("position")))
    placed = (ranked.withColumn("slot", slot).withColumn("position", F.when(F.col("rank") >= F.col("used"), position))
              .withColumn("parts", parts).select("*", F.posexplode("parts").alias("part", "from"))
              .withColumn("size", F.coalesce(F.get("parts", F.col("part") + 1), F.col("length")) - F.col("from"))
              .withColumn("in_stream", F.col("position") + F.col("from")))
    # The last end at or before a place; windows before the first of them have their own borders.
    tail = F.size(F.filter(last, lambda e: e <= F.col("in_stream")))
    begins = F.when(tail == 0, F.floor(F.col("in_stream") / capacity) * capacity).otherwise(F.element_at(last, F.greatest(tail, F.lit(1))))
    number = F.when(tail == 0, F.floor(F.col("in_stream") / capacity)).otherwise(whole_windows + tail - 1)
    outside = F.col("position").isNull()
    ids = F.substring(F.col("ids"), (4 * F.col("from") + 1).cast("int"), (4 * F.col("size")).cast("int"))
    return placed.select(
        "doc_id", (F.col("start") + F.col("from")).alias("start"), F.col("size").alias("length"),
        F.when(F.size("parts") == 1, F.col("ids_crc32")).otherwise(F.crc32(ids)).alias("ids_crc32"), "doc_tokens",
        F.when(outside, F.col("slot.first") + F.col("rank") - F.col("slot.rank")).otherwise(sequences + number).alias("sequence_id"),
        F.when(outside, F.col("slot.offset")).otherwise(F.col("in_stream") - begins).alias("offset"),
        *([ids.alias("ids")] if with_ids else []))
