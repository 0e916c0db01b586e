"""Connected components of a link table, as a series of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctual.llm._store import stored


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node of its component.

    Alternating large-star and small-star rounds: every round points nodes at
    smaller neighbours, until all point at the smallest.  The number of rounds
    grows with the logarithm of the longest path.  Neighbours are never
    gathered: each round is an aggregation (minimum) and a join with it, so a
    node with very many links is split like any other skewed join.
    """
    edges = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*") \
            .where("u <> v").distinct()
        edges = stored(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    rooted = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = rooted.select(F.col("component").alias("node"), "component").distinct()
    return rooted.union(roots)
