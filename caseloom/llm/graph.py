"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import materialize, remove_table


def _smallest(edges: DataFrame) -> DataFrame:
    """Each ``u`` with the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, for every node of an edge ``a``, ``b``.

    Large-star and small-star rounds: each node hands its smallest neighbour to
    its larger, then its smaller neighbours, until the edges are stars. A star's
    leaves are never gathered in a row; a hot centre is only a join key, and its
    minimum is folded before the shuffle. Each round is written to the shared
    folder, so a lost executor costs no earlier round, and removed after the
    next one. Self loops and repeated edges change nothing; a null end is no
    edge; no edges give no rows.
    """
    now = (edges.where("a is not null and b is not null")
           .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    now, before = materialize(now, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.where("v >= u").join(_smallest(both), "u")
                 .select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))
        # Every node keeps a loop to itself, which small-star turns into its edge to the centre.
        loops = large.unionByName(large.select("u", F.col("u").alias("v"))).distinct()
        small = (loops.join(_smallest(loops), "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        following = materialize(small, "edges")
        state = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        remove_table(now)
        now = following
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = state
