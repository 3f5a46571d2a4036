"""Connected components of a link table by alternating star contractions.

The links stay in tables; each round writes them to the shared folder, so neither lineage nor
a lost executor holds a round up.  A node's smallest neighbour comes from an aggregation which
combines in each task first, and reaches the links by a join, whose hot keys are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import stage


def _stars(links: DataFrame) -> DataFrame:
    """Large star, then small star, of links ``(u, v)`` with ``u > v``."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u != v").distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    joined = large.join(lowest, "u")
    small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) of every node of ``links (u, v)`` but roots."""
    current = stage(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links"
    )
    state = _state(current)
    while state[0]:
        current = stage(_stars(current), "links")
        last, state = state, _state(current)
        if state == last:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
