"""Joins of many rows with one row of a table, and membership filters of fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Store

#: A key held by more than one row in this many is hot, so there are never more hot keys than this.
HOT_SHARE = 4096
#: Places of a membership filter (8 MiB).
FILTER_BITS = 1 << 26


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


def membership_bits(places: DataFrame, column: str) -> np.ndarray:
    """A bitmap with the bits of all ``column`` values (0 to ``FILTER_BITS`` - 1) set, as 64-bit words.

    Its size is fixed: the more values there are, the more others it lets
    through, so an exact join has to follow.
    """
    bit = F.expr(f"shiftleft(1L, cast({column} % 64 as int))")
    words = places.select(F.shiftright(column, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return bits
