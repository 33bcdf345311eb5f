"""Connected components by large-star and small-star rounds over an edge table.

Each round replaces every edge by one that points to a smaller node of the same
component, so that a component ends as a star round its smallest node.  Minima
are pre-aggregated before the shuffle and joined back with the rows of a hot node
spread over several tasks, so a node with very many edges never has to fit in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.operators.skew import lookup_join
from snaplake.session import materialise_counted

MAX_ROUNDS = 60


def _cut(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges from a written table, and what tells one set of edges from another."""
    kept, seen = materialise_counted(
        edges,
        n=F.count(F.lit(1)),
        total=F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")),
    )
    return kept, (seen["n"], seen["total"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    low = both.groupBy("node").agg(F.min("root").alias("low")).select("node", F.least("node", "low").alias("low"))
    return (
        lookup_join(both, low, ["node"]).where(F.col("root") > F.col("node"))
        .select(F.col("root").alias("node"), F.col("low").alias("root")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("node").agg(F.min("root").alias("low"))
    joined = lookup_join(edges, low, ["node"])
    return (
        joined.where(F.col("root") != F.col("low")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        .unionByName(low.select("node", F.col("low").alias("root"))).distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """``node -> root`` for every node that has an edge, ``root`` being the smallest node of its component.

    ``edges`` has columns ``node`` and ``root`` of one orderable type.  Null ends
    and loops are ignored; nodes without edges do not occur in the result.
    """
    start = edges.where("node <> root").select(
        F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")
    )
    current, before = _cut(start.distinct())
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        current, now = _cut(_small_star(_large_star(current)))
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return current.unionByName(current.select(F.col("root").alias("node"), "root").distinct())
