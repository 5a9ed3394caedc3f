"""Mixing sources to target weights.

The blocks of a source (its documents, in a fixed random order) get the windows
of a Pfair task: with the share w of a source, its i-th block is released at
slot floor((i - 1) / w) and due at slot ceil(i / w). Of the released blocks the
earliest due one takes the next slot. At every prefix each source then has less
than one block more or less than its share.

Weights are whole numbers, so the schedule repeats: in each round a source with
weight a places a blocks. A round in which a source runs out takes what is left
of it as its weight. Only rounds that differ are scheduled, at most two per
source, on the driver and from weights and counts alone; documents find their
slot from their rank in the source.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import free_name, sums_before

# Sum of the default weights: shares are kept to half a percent, or with many sources to a twentieth of a mean share.
RESOLUTION, PER_SOURCE = 200, 20
# Slots the driver schedules at most, in up to two rounds for each source: what many sources' shares are kept to follows from it.
PLAN_SLOTS = 4_000_000
# Documents of a source that are ranked in one group.
BUCKET_ROWS = 4096


def resolution_of(sources: int) -> int:
    """Sum of the weights of so many sources."""
    return max(RESOLUTION, sources, min(PER_SOURCE * sources, PLAN_SLOTS // (2 * max(1, sources))))


def root_weights(counts: Mapping[str, int], resolution: int | None = None) -> dict[str, int]:
    """Shares by the root of the counts, which raises small sources, as whole numbers of at least 1.

    Numbers that add up to ``resolution`` but for the ones that are raised to 1:
    rounded down, then the largest remainders up.
    """
    if not counts:
        return {}
    resolution = resolution or resolution_of(len(counts))
    total = sum(math.sqrt(n) for n in counts.values())
    exact = {key: resolution * math.sqrt(n) / total for key, n in counts.items()}
    weights = {key: max(1, math.floor(x)) for key, x in exact.items()}
    for key in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[:max(0, resolution - sum(weights.values()))]:
        weights[key] += 1
    return weights


def schedule(quotas: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one round that places ``quotas`` blocks."""
    length = sum(quotas.values())
    waiting: list[tuple[int, int, str, int]] = []
    slots: dict[str, list[int]] = {key: [] for key in quotas}

    def window(key: str, i: int) -> tuple[int, int]:
        return i * length // quotas[key], -((i + 1) * -length // quotas[key])

    # Blocks by release; one of each source waits at a time, for windows follow each other.
    coming = [(0, window(key, 0)[1], key, 0) for key, quota in sorted(quotas.items()) if quota]
    heapq.heapify(coming)
    for slot in range(length):
        while coming and coming[0][0] <= slot:
            _, due, key, i = heapq.heappop(coming)
            heapq.heappush(waiting, (due, -quotas[key], key, i))
        due, _, key, i = heapq.heappop(waiting)
        assert slot < due
        slots[key].append(slot)
        if i + 1 < quotas[key]:
            release, due = window(key, i + 1)
            heapq.heappush(coming, (release, due, key, i + 1))
    return slots


def _phases(counts: Mapping[str, int], weights: Mapping[str, int]) -> dict[str, list[tuple[int, int, int, list[int]]]]:
    """For each source the runs of equal rounds: first round, first position, length of a round, slots."""
    ends = {r for key, n in counts.items() for r in (n // weights[key], -(-n // weights[key]))}
    phases: dict[str, list[tuple[int, int, int, list[int]]]] = {key: [] for key in counts}
    position, starts = 0, sorted(ends | {0})
    for start, end in zip(starts, starts[1:]):
        quotas = {key: max(0, min(weights[key], n - start * weights[key])) for key, n in counts.items()}
        length = sum(quotas.values())
        for key, slots in schedule(quotas).items():
            if slots:
                phases[key].append((start, position, length, slots))
        position += length * (end - start)
    return phases


def _key(source: Column) -> Column:
    """Null is a source of its own."""
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("source "), source.cast("string")))


def mix(docs: DataFrame, weights: Mapping[str | None, int] | None = None, source: str = "source",
        key: str = "doc_id") -> DataFrame:
    """``docs`` with ``position``, its place from 0 in the mixture, ``weight`` and ``block``, its rank in its source.

    ``weights`` gives whole numbers by source (by default ``root_weights``); a
    source it leaves out weighs 1. The number of sources must be small, as that
    of weights is; counts per source are all the driver sees. Sources that run
    out leave their share to the others, so no row is dropped and none repeats.
    Rows with null or repeated keys are ranked by all their columns; full copies
    in any order. Null is a source of its own. Columns of the same names as the
    added ones are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    # Numbered names inside, so that no column of the table can meet another.
    own = [(c, kind) for c, kind in docs.dtypes if c not in ("position", "weight", "block")]
    inner = {c: f"c{i}" for i, (c, _) in enumerate(own)}
    rows = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in inner.items()])
    # Maps have no hash; rows that differ in nothing else come in any order.
    hashed_by = [inner[c] for c, kind in own if "map<" not in kind]
    key = inner[key]
    keyed = rows.withColumn("source", _key(F.col(inner[source])))
    counts = {row["source"]: row["n"] for row in keyed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        chosen = root_weights(counts)
    else:
        named = {"null" if k is None else f"source {k}": int(w) for k, w in weights.items()}
        chosen = {k: max(1, named.get(k, 1)) for k in counts}
    phases = _phases(counts, chosen)
    schema = ("source string, weight int, buckets bigint, "
              "phases array<struct<start: bigint, position: bigint, length: int, slots: array<int>>>")
    plan = spark.createDataFrame([(k, chosen[k], -(-counts[k] // BUCKET_ROWS), phases[k]) for k in sorted(counts)], schema)

    # Ranks without a window over a whole source: buckets by hash, ranks inside, bucket sizes summed before.
    # The plan is bounded by the sources and is broadcast: a join by source would deal whole sources to single tasks.
    hashed = (keyed.join(F.broadcast(plan), "source").withColumn("hash", F.xxhash64(key))
              .withColumn("bucket", F.pmod("hash", "buckets")))
    offsets = sums_before(hashed.groupBy("source", "bucket").agg(F.count("*").alias("size")), "bucket", "size", ["source"])
    inside = Window.partitionBy("source", "bucket").orderBy("hash", key, F.xxhash64(*hashed_by))
    ranked = (hashed.withColumn("place", F.row_number().over(inside)).join(offsets, ["source", "bucket"], "left")
              .withColumn("block", F.col("before") + F.col("place") - 1).withColumn("turn", F.floor(F.col("block") / F.col("weight"))))
    phase = F.element_at(F.filter("phases", lambda p: p["start"] <= F.col("turn")), -1)
    placed = ranked.withColumn("phase", phase).withColumn(
        "position", F.col("phase.position") + (F.col("turn") - F.col("phase.start")) * F.col("phase.length")
        + F.element_at(F.col("phase.slots"), (F.col("block") - F.col("turn") * F.col("weight") + 1).cast("int")))
    return placed.select(*[F.col(name).alias(c) for c, name in inner.items()], "position", "weight", "block")


def placed(docs: DataFrame, weights: Mapping[str | None, int] | None = None, position: str = "position") -> DataFrame:
    """``docs``, all rows and columns, with their place in the mixture as ``position``, a name that ``docs`` does not use."""
    own = docs.columns
    # Columns of the table that clash with the added ones come back under their own names.
    clash = {c: free_name(docs, f"own_{c}") for c in own if c in ("position", "weight", "block")}
    mixture = mix(docs.withColumnsRenamed(clash), weights)
    return mixture.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in own], mixture["position"].alias(position))


def mixed_order(docs: DataFrame, weights: Mapping[str | None, int] | None = None) -> DataFrame:
    """``docs``, all rows and columns, laid out in the order of the mixture: written, its files follow each other."""
    position = free_name(docs, "_mix_position")
    return placed(docs, weights, position).orderBy(position).drop(position)
