"""Exact nearest codes by incremental multi-index hashing.

A vector's code is the signs of its elements, 64 bits in four segments of 16.
Two codes at most 4 r + 3 bits apart agree within r bits in some segment. Round
r looks up, for every query not yet settled, the segment values at exactly r
bits from its own, verifies the full distance of what it finds and keeps the
nearest. A query is settled when its k-th distance is at most 4 r + 3, which
proves that nothing nearer is left.

Rows of equal codes are one entry of the index. Of those only the smallest ids
can be among the nearest, so an entry is short however many copies there are.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import materialize, remove_table

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
NEIGHBOURS = 10


def sign_code(vector: Column) -> Column:
    """Bit i of the bigint is 1 if element i is positive; null elements are not.

    Elements from the 65th on are folded onto the bits by exclusive or, so
    vectors of any length have a code. A null vector has none.
    """
    bits = F.transform(vector, lambda x, i: F.when(
        x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(i, F.lit(BITS)).cast("int"))
    ).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda code, bit: code.bitwiseXOR(bit))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _segments(code: Column) -> Column:
    return F.array(*[F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(code, s * WIDTH).bitwiseAND(
        F.lit((1 << WIDTH) - 1).cast("bigint")).cast("int").alias("value")) for s in range(SEGMENTS)])


def _masks(radius: int) -> Column:
    """All segment values with ``radius`` bits, one literal."""
    values = [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)]
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """query_id, ``rank`` from 1, neighbour_id and ``distance``: the k nearest rows of each query, exactly.

    Both tables have id and code. A query's own id is no neighbour of it; equal
    distances rank by id. Fewer rows than k give them all. Rows and queries
    without an id or a code take no part; repeated rows count once.
    """
    rows = rows.where("id is not null and code is not null").select("id", "code")
    queries = queries.where("id is not null and code is not null").select("id", "code").distinct()
    # The window is limited to k + 1 rows per code before the shuffle.
    by_id = Window.partitionBy("code").orderBy("id")
    entries = materialize(
        rows.distinct().withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
        .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    index = materialize(
        entries.select("code", "ids", F.explode(_segments(F.col("code"))).alias("s"))
        .select("s.segment", "s.value", "code", "ids"), "index")
    # As many ids as could be found, of k + 1 wanted: the query itself is one.
    wanted = entries.agg(F.least(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.lit(k + 1))).first()[0]
    active = materialize(queries.select(F.col("code").alias("query")).distinct(), "active")
    best = materialize(active.limit(0).select("query", F.col("query").alias("code"), F.lit(0).alias("distance"),
                                              F.array(F.lit(0).cast("bigint")).alias("ids")), "best")
    settled = []
    nearest_codes = Window.partitionBy("query").orderBy("distance", F.element_at("ids", 1))
    for radius in range(WIDTH + 1):
        probes = (active.select("query", F.explode(_segments(F.col("query"))).alias("s"))
                  .select("query", "s.segment", "s.value", F.explode(_masks(radius)).alias("mask"))
                  .select("query", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value")))
        # Neither side is small, though Spark may take the exploded probes for it.
        found = probes.join(index.hint("merge"), ["segment", "value"]).select(
            "query", "code", distance(F.col("query"), F.col("code")).alias("distance"), "ids")
        # A code is met in each segment that is near enough; one row of it is kept.
        ranked = (best.unionByName(found).dropDuplicates(["query", "code"])
                  .withColumn("place", F.row_number().over(nearest_codes)).where(F.col("place") <= k + 1).drop("place"))
        ranked = materialize(ranked, "best")
        proved = SEGMENTS * radius + SEGMENTS - 1
        done = (ranked.where(F.col("distance") <= proved).groupBy("query").agg(F.sum(F.size("ids")).alias("n"))
                .where(F.col("n") >= wanted).select("query"))
        settled.append(ranked.join(done, "query", "left_semi"))
        remaining = materialize(active.join(done, "query", "left_anti"), "active")
        left = materialize(ranked.join(done, "query", "left_anti"), "best")
        for table in (active, best):
            remove_table(table)
        active, best = remaining, left
        if active.isEmpty():
            break
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    by_rank = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return (queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
            .join(result, "query").select("query_id", "distance", F.explode("ids").alias("neighbour_id"))
            .where("neighbour_id <> query_id")
            .withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
            .select("query_id", "rank", "neighbour_id", "distance"))


def search(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = 100) -> DataFrame:
    """The k nearest rows of every row whose vec_id is divisible by ``every``, among all rows."""
    coded = embeddings.select(F.col("vec_id").cast("bigint").alias("id"), sign_code(F.col("embedding")).alias("code"))
    coded = materialize(coded, "vectors")
    return nearest(coded, coded.where(F.col("id") % every == 0), k)


def search_sql(k: int = NEIGHBOURS, every: int = 100) -> str:
    """What ``search`` returns for the table embeddings, compared pair by pair."""
    return f"""
    WITH pairs AS (
      SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id,
        len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (r.embedding[i] > 0)))::INT AS distance
      FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % {every} = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INT AS rank,
      neighbour_id, distance FROM pairs QUALIFY rank <= {k}"""
