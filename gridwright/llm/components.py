"""Connected components of a graph held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, hot_limit, split_join


def _star(links: DataFrame, large: bool, scratch: Scratch, name: str, most: int, total: int) -> DataFrame:
    """One step: hang a node's larger (large) or smaller neighbours under the least node that it knows.

    most, total: links of the node that has most of them, and of all. A hub's links stay where they are and get its least node by broadcast."""
    both = links.select("_a", "_b")
    if large:
        both = both.unionByName(links.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
    least = both.groupBy("_a").agg(F.least(F.min("_b"), F.col("_a")).alias("_m"), F.count("*").alias("_n"))
    if most > hot_limit(total):
        least = scratch.save(least, name)
        hung = split_join(both, least, ["_a"], "_n")
    else:
        hung = both.join(least, "_a")
    if large:
        hung = hung.where(F.col("_b") > F.col("_a")).select(F.col("_b").alias("_a"), F.col("_m").alias("_b"))
    else:
        hung = hung.select(F.col("_b").alias("_a"), F.col("_m").alias("_b")).unionByName(least.select("_a", F.col("_m").alias("_b")))
    return hung.where(F.col("_a") != F.col("_b")).distinct()


def _shape(links: DataFrame) -> tuple[int, int, int]:
    """Under how many nodes a node hangs, one more if it holds others (1 at most: settled; 0 without links); links of the node that has
    most; all links. A link's _b is the lesser, so a settled node hangs under the least of its component."""
    ends = links.select(F.col("_a").alias("_n"), F.lit(1).alias("_up"), F.lit(0).alias("_down"))
    ends = ends.unionByName(links.select(F.col("_b").alias("_n"), F.lit(0).alias("_up"), F.lit(1).alias("_down")))
    nodes = ends.groupBy("_n").agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down"))
    hung = F.when(F.col("_up") > 0, F.col("_up") + F.least(F.col("_down"), F.lit(1)))
    row = nodes.agg(F.max(hung), F.max(F.col("_up") + F.col("_down")), F.sum("_up")).first()
    return tuple(x or 0 for x in row)


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """_a (node), _b (least node of its component) for every node that has a link, the least node itself left out.

    links: columns _a, _b of any ordered type. Alternates large and small stars, each written to the shared folder, until
    every node hangs under one node that hangs under none: a number of rounds that grows as the logarithm of the longest path.
    """
    links = links.where(F.col("_a") != F.col("_b"))
    links = scratch.save(links.select(F.greatest("_a", "_b").alias("_a"), F.least("_a", "_b").alias("_b")).distinct(), f"{name}0")
    step = 0
    while True:
        hung, most, total = _shape(links)
        if hung <= 1:
            return links
        step += 1
        large = _star(links, True, scratch, f"{name}{step}-large", most, 2 * total)
        if most > hot_limit(2 * total):  # a star that reads its links twice
            large = scratch.save(large, f"{name}{step}-half")
        links = scratch.save(_star(large, False, scratch, f"{name}{step}-small", most, total), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}", *(f"{name}{step}-{part}" for part in ("large", "half", "small")))
