"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is one aggregation and one join over the remaining edges; nothing is collected.
Edges shrink towards stars around the smallest node, so a few rounds do. Each round is written
to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.store import stored


def _smallest(pairs: DataFrame) -> DataFrame:
    """Links each neighbour ``v`` of ``u`` to the smallest of ``u`` and its neighbours."""
    low = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(low, "u")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .distinct())
    joined = _smallest(large)
    # u > v in every edge here; the smallest neighbour becomes the link of all others and of u.
    small = (joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
                           .alias("u"), F.col("m").alias("v")))
    return small.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; root is the smallest node reached.

    Null ends and loops are ignored; repeated and reversed edges do not matter; no edge gives
    no row.
    """
    edges = (edges.where("u is not null and v is not null and u <> v")
             .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    edges = stored(edges, "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % (1 << 40)))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = stored(_round(edges), "edges")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return star.union(roots)
