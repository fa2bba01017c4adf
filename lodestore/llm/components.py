"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, shuffles_dropped, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    moved = joined.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(joined.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every linked node.

    ``links`` has the columns ``a`` and ``b`` (long); direction, repetition, loops
    and nulls don't matter. Returns ``node`` and ``component`` for nodes that have a
    link to another node. Each round halves the longest paths, and the contraction
    uses only grouped minima and equi-joins, so a node with very many links is split
    by the adaptive skew join. Each round's links are a written table; the one before is
    deleted then.
    """
    since, spark = written(), links.sparkSession
    sides = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = materialise(sides.distinct(), "edges")
    before = None
    for _ in range(rounds):
        edges = materialise(_small_star(_large_star(edges)), "edges")
        discard(spark, since, keep=1)
        with shuffles_dropped(spark):
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots).distinct()
