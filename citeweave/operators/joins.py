"""Joins that hold under hot keys, and pointers followed to their roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Store

#: A key held by more than one row in this many is hot, so there are never more hot keys than this.
HOT_SHARE = 4096


def lookup(rows: DataFrame, table: DataFrame, key: str, store: Store, name: str) -> DataFrame:
    """``rows`` joined with the one row that ``table`` holds for their ``key``; rows without one go.

    Hot keys, ``HOT_SHARE`` of them at most, take their row by broadcast, so a
    key that a third of all rows hold is never brought to one task; the other
    keys are dealt out.  ``rows`` should be a written table: it is read again.
    """
    total = rows.count()
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HOT_SHARE > total).select(key)
    hot = store.put(table.join(counts, key, "left_semi"), name)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def follow(pointers: DataFrame, store: Store, name: str = "follow") -> DataFrame:
    """(node, root) from (node, parent), where a root is its own parent.

    Every round replaces each pointer by its parent's, so chains of any length
    are followed in as many rounds as their length has binary digits.  Nodes
    that point at a root already are set aside.
    """
    hop = store.put(pointers.select("node", "parent"), f"{name}-0")
    number, settled = 0, None
    while True:
        onward = hop.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        number += 1
        hop = store.put(lookup(hop, onward, "parent", store, f"{name}-hot{number}").select("node", F.col("grand").alias("parent"), (F.col("grand") == F.col("parent")).alias("done")), f"{name}-{number}")
        store.drop(f"{name}-{number - 1}", f"{name}-hot{number}")
        if not hop.filter("not done").head(1):
            return hop.select("node", F.col("parent").alias("root"))
