"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import stored


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(u, v)`` as ``(node, component)``, component the smallest node.

    Large-star and small-star in turn: each round hangs every neighbour of a node on the smallest one it
    sees, which needs about log(n) rounds for any shape of graph. A node with very many neighbours is
    first reduced by a partial ``min`` and then met in a join, which Spark splits when it is skewed.
    Nodes without an edge do not appear; loops and null ends are ignored. Each round is written to the
    shared folder; the driver sees two numbers a round.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = stored(e.where((F.col("u") != F.col("v")) & edges.u.isNotNull() & edges.v.isNotNull()).distinct(), label)
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == seen or mark["n"] == 0:
            break
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(root.select("u", F.col("m").alias("v"))).distinct(), label)
    hung = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return hung.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
