"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import staged


def star(links: DataFrame, large: bool) -> DataFrame:
    """Re-hang neighbours of each node on the smallest node of its neighbourhood.

    The large step moves larger neighbours, the small step the smaller ones and the
    node itself. The smallest neighbour is an aggregate with a map-side part. It groups by
    one more column than the join has, so that the join shuffles both sides and adaptive
    execution can split a node with very many links.
    """
    if large:
        pairs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = pairs.groupBy("a", (F.col("a") > 0).alias("positive")).agg(F.min("b").alias("least"))
    lowest = lowest.select("a", F.least("least", "a").alias("low"))
    joined = pairs.join(lowest, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is linked to, over links (a, b).

    Every node of a link has a row. The number of rounds grows with the logarithm of
    the number of nodes; the state is staged in the shared folder each round.
    """
    state = staged(links.select("a", "b").where("a <> b").distinct(), "components")
    mark = None
    while True:
        state = staged(star(star(state, large=True), large=False), "components")
        # Done once the set of links no longer changes; compared by order-free sums.
        new = state.agg(
            F.count("*"),
            F.bit_xor(F.xxhash64("a", "b")),
            F.bit_xor(F.xxhash64("b", "a")),
        ).first()
        if new == mark:
            break
        mark = new
    members = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
