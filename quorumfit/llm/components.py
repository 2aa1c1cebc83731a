"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.llm.tables import written


def _stars(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return (
        both.where("b > a").join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): component is its smallest node.

    Nodes without an edge to another node are not returned. Every round is written to the
    shared folder; only a count and a checksum of each round reach the driver. The rounds
    end when a round changes no edge. Null ends and loops are ignored; an empty table
    gives an empty table.
    """
    now = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = _print(now)
    while seen[0]:
        after = written(_small(_stars(now)), "edges")
        now, before, seen = after, seen, _print(after)
        if seen == before:
            break
    nodes = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = nodes.select(F.col("component").alias("id"), "component").distinct()
    return nodes.union(roots)
