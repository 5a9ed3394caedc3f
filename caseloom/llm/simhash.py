"""Near-duplicates by SimHash.

A fingerprint has 64 bits; two documents link when theirs differ in at most
``MAX_DISTANCE`` of them, and classes are what links connect.

Search: the fingerprint is cut into 32 segments of two bits and mapped to the
bit counts of the segments, a point of a 32-dimensional grid. Two points are
never farther apart in Manhattan distance than their fingerprints in bits, so a
link has a Manhattan distance of 3 at most. Spread over six groups of segments
that leaves three groups or more without any difference: for one of the 20
choices of three groups both points have the same coordinates, and the range
join becomes an equality join on 20 projections of the grid. Within a cell the
Manhattan distance over all segments filters first, then the exact one decides.

The counts are kept as the fingerprint with the two bits of each segment sorted
(00, 01, 11), so that a Manhattan distance is the number of differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import free_name, hashes, per_batch, utf8, words_of
from caseloom.llm.graph import components
from caseloom.session import materialize

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
# Bits of the six groups; each is a whole number of two-bit segments.
GROUPS = ((0, 12), (12, 24), (24, 34), (34, 44), (44, 54), (54, 64))
# A cell with more fingerprints than this is split into parts that are met two by two.
CELL_ROWS = 4096
# Cells up to this size are compared lag by lag, for all cells of a batch at once.
SMALL_CELL = 16

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_BASE = (np.arange(8) * 256)[None, :]


def fingerprint(words: list[bytes], shingle_words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the shingles' hashes; no words give zero."""
    if not words:
        return 0
    n = len(words) - shingle_words + 1
    if n <= 1:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)]))
    octets = hashes(shingles, n).view(np.uint8).reshape(n, 8)
    seen = np.bincount((octets + _BYTE_BASE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen[:, :, None] * _BYTE_BITS[None, :, :]).sum(axis=1).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, also: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``fp``, the fingerprint as a signed bigint, and the bigints ``also``; one row per document, null text is empty."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(words_of(t, lower=True), shingle_words) for t in utf8(batch.column("text"))]
        kept = [batch.column(name) for name in ("doc_id", *also)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(fps, pa.int64())], ["doc_id", *also, "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *also).mapInArrow(
        per_batch(work), ", ".join(f"{name} bigint" for name in ("doc_id", *also, "fp")))


def segment_counts(fp: Column) -> Column:
    """Bit counts of the two-bit segments, each as 00, 01 or 11."""
    pairs = F.lit(0x5555555555555555)
    shifted = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(shifted).bitwiseAND(pairs).bitwiseOR(F.shiftleft(fp.bitwiseAND(shifted).bitwiseAND(pairs), 1))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _grids() -> list[int]:
    masks = [sum(1 << b for b in range(*group)) for group in GROUPS]
    return [_signed(sum(chosen)) for chosen in combinations(masks, 3)]


def _sorted_bits(fps: np.ndarray) -> np.ndarray:
    pairs = np.uint64(0x5555555555555555)
    shifted = fps >> np.uint64(1)
    return ((fps | shifted) & pairs) | ((fps & shifted & pairs) << np.uint64(1))


def _forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect exactly what the links among ``fps`` connect, at most one per fingerprint.

    A fingerprint that is reached is never compared again as a partner, so a
    dense cell takes few comparisons and no pair is kept.
    """
    left, counts = fps, _sorted_bits(fps)
    froms, tos = [], []
    while len(left):
        frontier, left, counts = [left[0]], left[1:], counts[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(counts ^ _sorted_bits(at)) <= distance
            places = np.flatnonzero(near)
            places = places[np.bitwise_count(left[places] ^ at) <= distance]
            if len(places):
                found = left[places]
                froms.append(np.full(len(found), at))
                tos.append(found)
                frontier.extend(found)
                rest = np.ones(len(left), bool)
                rest[places] = False
                left, counts = left[rest], counts[rest]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(froms), np.concatenate(tos)) if froms else (empty, empty)


def _cell_edges(starts: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within cells; ``starts`` are the cells' first places in ``fps``."""
    sizes = np.diff(np.append(starts, len(fps)))
    cell = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    cell_s, fps_s, counts = cell[small], fps[small], _sorted_bits(fps[small])
    froms, tos = [], []
    for lag in range(1, SMALL_CELL):
        if lag >= len(fps_s):
            break
        near = (cell_s[lag:] == cell_s[:-lag]) & (np.bitwise_count(counts[lag:] ^ counts[:-lag]) <= distance)
        places = np.flatnonzero(near)
        places = places[np.bitwise_count(fps_s[places] ^ fps_s[places + lag]) <= distance]
        froms.append(fps_s[places])
        tos.append(fps_s[places + lag])
    for i in np.flatnonzero(sizes > SMALL_CELL):
        a, b = _forest(fps[starts[i]:starts[i] + sizes[i]], distance)
        froms.append(a)
        tos.append(b)
    empty = np.empty(0, np.uint64)
    return np.concatenate([empty, *froms]), np.concatenate([empty, *tos])


def _edges_of_cells(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell; the last cell of a batch waits for the next one.
        keys, values = np.empty((0, 3), np.int64), np.empty(0, np.uint64)

        def edges(cut: int) -> pa.RecordBatch:
            head = keys[:cut]
            starts = np.flatnonzero(np.append(True, (head[1:] != head[:-1]).any(axis=1))) if cut else np.empty(0, int)
            a, b = _cell_edges(starts, values[:cut], distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            more = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64)
                             for n in ("grid", "cell", "part")], axis=1)
            fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys, values = np.concatenate([keys, more]), np.concatenate([values, fps])
            changes = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            if len(changes):
                cut = changes[-1] + 1
                yield edges(cut)
                keys, values = keys[cut:], values[cut:]
        if len(values):
            yield edges(len(values))

    return run


def links(fps: DataFrame, distance: int = MAX_DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges ``a``, ``b`` between fingerprints that connect what all links connect.

    ``fps`` has one row per fingerprint. Cells of one fingerprint go at once. A
    cell of more than ``cell_rows`` is dealt into k parts, and each two of them
    meet in a task of their own, so no task holds more than two parts.
    """
    grids = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("grid"), F.lit(mask).alias("mask"))
                      for i, mask in enumerate(_grids())])
    cells = (fps.select("fp", segment_counts(F.col("fp")).alias("counts"))
             .select("fp", "counts", F.explode(grids).alias("g"))
             .select(F.col("g.grid").alias("grid"), F.col("counts").bitwiseAND(F.col("g.mask")).alias("cell"), "fp")
             .withColumn("size", F.count("*").over(Window.partitionBy("grid", "cell")))
             .where("size > 1"))
    parts = F.ceil(F.col("size") / F.lit(cell_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    # Part p meets q >= p in the task p * parts + q.
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1),
                        lambda q: F.least(q, F.col("own")) * F.col("parts") + F.greatest(q, F.col("own")))
    dealt = (cells.withColumn("parts", parts).withColumn("own", own)
             .select("grid", "cell", F.explode(meets).alias("part"), "fp"))
    return (dealt.repartition("grid", "cell", "part").sortWithinPartitions("grid", "cell", "part")
            .mapInArrow(_edges_of_cells(distance), "a bigint, b bigint"))


def _with_class(firsts: DataFrame, distance: int) -> DataFrame:
    """``firsts``, one row per ``fp``, with the ``label`` of its class."""
    classes = components(links(firsts.select("fp"), distance)).withColumnRenamed("node", "fp")
    # Most fingerprints have no link; they are their own class.
    return firsts.join(classes, "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id of the class; one row per row.

    Only doc_id and text are read, so other columns may have any name. Null or
    blank texts have the fingerprint zero and link like any other. Repeated rows
    share a class. A null doc_id names no class: a class without any other
    doc_id has a null ``component_id``. An empty table gives an empty one.
    """
    fps = materialize(fingerprints(docs, shingle_words), "simhash")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    joined = _with_class(firsts, distance)
    ids = joined.groupBy("label").agg(F.min("first").alias("component_id"))
    named = joined.join(ids, "label").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one document of each class, that of smallest doc_id; all columns stay as they are.

    Of different texts under that doc_id the one of the smallest XXH64 stays, of
    rows that repeat doc_id and text the first by a hash of the other columns
    (maps aside). Rows without a doc_id stay, though they connect others: no
    class can be named after them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.where(F.col("doc_id").isNotNull())
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(text).alias("tid"))
    fps = materialize(fingerprints(rows, shingle_words, ["tid"]), "simhash")
    firsts = (fps.groupBy("fp").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tid"))).alias("first")))
    kept = (_with_class(firsts, distance).groupBy("label").agg(F.min("first").alias("first")).where("first is not null")
            .select(F.col("first.doc_id").alias("kept_id"), F.col("first.tid").alias("kept_tid")))
    key, tid, place = (free_name(docs, name) for name in ("_key", "_tid", "_place"))
    others = [c for c, kind in docs.dtypes if c not in ("doc_id", "text") and "map<" not in kind]
    marked = named.withColumns({key: F.col("doc_id").cast("bigint"), tid: F.xxhash64(text)})
    met = marked.join(kept, (marked[key] == kept["kept_id"]) & (marked[tid] == kept["kept_tid"]), "left_semi")
    # Rows of one document are next to each other after the join.
    first = Window.partitionBy(key, tid).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0))
    one = met.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return one.unionByName(docs.where(F.col("doc_id").isNull()))
