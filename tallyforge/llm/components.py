"""Connected components of a graph given as links, by alternating star contractions.

Every step groups links by node with a pre-combined minimum, stores that, and joins it
back with a plain join, which adaptive execution splits at nodes with many links. The
number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import durable


def _both_ways(links: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return links.select(F.inline(ends))


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    around = durable(_both_ways(links))
    least = durable(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Links point from larger to smaller."""
    least = durable(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, where root is the smallest node that it can reach.

    ``links`` has two long columns; links of a node with itself, repeated and NULL
    links count for nothing. Nodes without a link are not returned.
    """
    a, b = (F.col(c) for c in links.columns[:2])
    now = durable(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        now = durable(_small_star(durable(_large_star(now))))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
