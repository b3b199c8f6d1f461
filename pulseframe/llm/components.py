"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Both steps replace links by links to the smallest neighbour, as a map-side combined minimum and a join, so the star of a
hot node is never gathered in one task. The number of rounds grows with the logarithm of the longest path. Each round's
links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.shared import store


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _least(links: DataFrame) -> DataFrame:
    """For each node ``a`` the smallest of its neighbours ``b`` and itself."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node. NULLs take no part."""
    links = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = _state(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.join(_least(both), "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").distinct())
        least = _least(large)
        small = (large.join(least, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
                 .unionByName(least.select("a", F.col("least").alias("b"))).where("a > b").distinct())
        links = store(small)
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
