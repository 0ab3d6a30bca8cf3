"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Large-star and small-star steps in turn until nothing changes: each task sees a node with its smallest neighbour, never
    a whole neighbourhood, and the number of rounds grows with the logarithm of the longest chain. Links with a null end
    are left out; repeated links and loops do not matter.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND u > v").distinct())
    mark = fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        large = materialize(large.distinct())
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(down, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, fingerprint(edges)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def fingerprint(edges: DataFrame) -> tuple:
    """Number of distinct edges and two sums of their hashes: equal for equal sets."""
    hashes = [F.xxhash64(F.lit(salt), "u", "v").cast("decimal(20,0)") for salt in (1, 2)]
    return tuple(edges.agg(F.count("*"), *[F.sum(h) for h in hashes]).first())
