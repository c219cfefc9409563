"""Connected components of a distributed edge table by repeated contraction.

Every round points each node at its least neighbour, shortens the pointers
once, renames both ends of every edge and drops loops and repeats; the labels
of all nodes follow.  Edges and labels stay in tables of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Store


def connected_components(edges: DataFrame, store: Store, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    live = store.put(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-edges0")
    labels, number = None, 0
    while live.head(1):
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Each node points at the least of itself and its neighbours.
        hop = store.put(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), f"{name}-hop{number}")
        onward = hop.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        short = store.put(hop.join(onward, "to", "left").select("node", F.coalesce("to2", "to").alias("to")), f"{name}-short{number}")
        if labels is None:
            renamed = short.select("node", F.col("to").alias("component"))
        else:
            renamed = labels.join(short.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = store.put(renamed, f"{name}-labels{number}")
        left = short.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = short.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = live.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a <> b").distinct()
        number += 1
        live = store.put(moved, f"{name}-edges{number}")
        store.drop(f"{name}-edges{number - 1}", f"{name}-hop{number - 1}", f"{name}-short{number - 1}", f"{name}-labels{number - 2}")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    return labels
