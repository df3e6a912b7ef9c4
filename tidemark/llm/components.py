"""Connected components of a large link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _placed(node: str, seed: int) -> Column:
    """A node behind its place in this round's order."""
    return F.struct(F.xxhash64(F.lit(seed), node).alias("place"), F.col(node).alias("id"))


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a long, b long); root is a node of the component.

    Each round orders the nodes anew by a seeded hash, points every node to its first neighbour or itself, follows
    that pointer once more, and contracts the links to pointers' ends. In a random order at least half of the
    nodes that still have links point elsewhere on average, whatever the order of their ids, so the rounds
    grow with the logarithm of the longest chain. No round gathers a node's neighbours, it only takes their minimum,
    so a hub costs no more than its links. Rounds are written tables. Links with a null end and self-links
    are ignored; no links give no rows.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    mapping, seed = None, 0
    while True:
        seed += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.withColumnRenamed("a", "node").groupBy("node").agg(F.min(_placed("b", seed)).alias("low"))
        first = stored(lows.select("node", F.least("low", _placed("node", seed))["id"].alias("next")), "pointers")
        if mapping is None and first.isEmpty():
            return first.select("node", F.col("next").alias("root"))
        hop = first.select(F.col("node").alias("next"), F.col("next").alias("end"))
        pointer = stored(first.join(hop, "next").select("node", "end"), "ends")
        if mapping is None:
            mapping = pointer.select("node", F.col("end").alias("root"))
        else:
            moved = pointer.select(F.col("node").alias("root"), "end")
            mapping = mapping.join(moved, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
        mapping = stored(mapping, "roots")
        ends_a = pointer.select(F.col("node").alias("a"), F.col("end").alias("ea"))
        ends_b = pointer.select(F.col("node").alias("b"), F.col("end").alias("eb"))
        contracted = edges.join(ends_a, "a").join(ends_b, "b").where("ea <> eb")
        edges = stored(contracted.select(F.least("ea", "eb").alias("a"), F.greatest("ea", "eb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return mapping
