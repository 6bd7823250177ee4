"""Connected components of a graph: by one task while it is small, by star contractions beyond."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nounspan.llm.common import checkpointed

# Edges that one task joins at once; more are contracted by shuffles.
SMALL_EDGES = 200_000


class Forest:
    """Components of names, as far as the links seen so far join them; the smallest name is the root."""

    def __init__(self):
        self.up: dict = {}

    def top(self, name):
        up = self.up
        while name in up:
            if up[name] in up:
                up[name] = up[up[name]]
            name = up[name]
        return name

    def join(self, a, b) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest, nodes = Forest(), set()
    for edges in batches:
        for a, b in zip(edges["v"], edges["m"]):
            forest.join(a, b)
            nodes.update((a, b))
    yield pd.DataFrame([(n, forest.top(n)) for n in nodes], columns=["node", "component"])


def components(edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """``node, component`` (the smallest node) for all ends of ``a, b`` edges.

    Up to ``small`` edges, counted, are joined in one task.  More take large and
    small star steps in turn (Kiveris et al., 2014) until nothing changes: a
    task then holds the arcs of a node at most, never a component.
    """
    arcs = checkpointed(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")
    ).distinct())
    if arcs.count() <= small:
        kind = arcs.schema["v"].dataType.simpleString()
        return arcs.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}")
    seen = None
    while True:
        both = arcs.unionByName(arcs.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.least(F.min("m"), F.first("v")).alias("low"))
        # Large star: every larger neighbour is tied to the smallest of the neighbourhood.
        large = (
            both.join(low, "v")
            .filter("m > v")
            .select(F.col("m").alias("v"), F.col("low").alias("m"))
            .filter("v <> m")
            .unionByName(low.filter("v <> low").select("v", F.col("low").alias("m")))
            .distinct()
        )
        # Small star: every smaller neighbour is tied to the smallest one.
        least = large.groupBy("v").agg(F.min("m").alias("low"))
        small = (
            large.join(least, "v")
            .select(F.col("m").alias("v"), F.col("low").alias("m"))
            .filter("v <> m")
            .unionByName(least.select("v", F.col("low").alias("m")))
            .distinct()
        )
        arcs = checkpointed(small)
        # The arcs as a whole, in two numbers.
        now = arcs.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    roots = arcs.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return arcs.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)
