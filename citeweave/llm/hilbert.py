"""Sharding along a Hilbert curve over quantised metadata dimensions.

Rows are sorted by the index of their cell on a Hilbert curve and the order is
cut into runs of equal row counts (the ``rows`` law), so each run covers a
compact region and its minima and maxima prune files on every dimension.

Documents with equal texts form a group.  A group takes the cell of its least
member and lies in one piece of the order, so only a group that meets the end
of a run is cut, and only as often as it is longer than a run.

Nulls: a null text counts as no bytes (and is no empty text), null metadata
shares one cell, a null key sorts first.  Ties on the curve are broken by the
text's hashes and then by the key; repeated rows each get their own slot; very
long texts are rows like others.  Empty tables give empty results; other columns
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store
from .tables import read_table

BITS = 10
#: Groups of at least one row in so many have their cells broadcast: there are no more of them than that.
HEAVY = 1000
#: monotonically_increasing_id keeps the partition above this many bits.
_LOCAL_BITS = 33


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of cells (dimensions x points); dimensions * bits may be at most 63."""
    x = cells.astype(np.uint64).copy()
    dims = len(x)
    one = np.uint64(1)
    # From axes to the transposed index: undo the excess rotations from the top bit down, then Gray-code.
    for level in range(bits - 1, 0, -1):
        low = (one << np.uint64(level)) - one
        for d in range(dims):
            set_here = (x[d] >> np.uint64(level)) & one == 1
            swap = np.where(set_here, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix = np.where((x[dims - 1] >> np.uint64(level)) & one == 1, fix ^ ((one << np.uint64(level)) - one), fix)
    x ^= fix
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << one | (x[d] >> np.uint64(level)) & one
    return index.astype(np.int64)


def quantise_size(c: Column, bits: int = BITS) -> Column:
    """Cell of a positive number on a logarithmic scale (monotone)."""
    steps = (1 << bits) / 40.0
    return F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * steps)).cast("long")


def quantise_category(c: Column, bits: int = BITS) -> Column:
    """Cell of a category by hash; equal values share a cell."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), F.lit(1 << bits)).cast("long")


def with_hilbert_index(df: DataFrame, cells: Sequence[str], name: str = "curve_index", bits: int = BITS) -> DataFrame:
    """Add the curve index of the quantised columns ``cells``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grid = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in cells])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hilbert_index(grid, bits), pa.int64())], [*b.schema.names, name])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{name}` long"
    return df.mapInArrow(run, schema)


def ranked(df: DataFrame, order: Sequence[str], store: Store, name: str = "ranked") -> tuple[DataFrame, int]:
    """Add ``rank`` (gapless from 0 in ``order``) without gathering rows; also the row count.

    Rows are range-partitioned, sorted and written once; only one count per
    partition reaches the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = store.put(placed, name)
    part = F.shiftright("_at", _LOCAL_BITS)
    counts = sorted(placed.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part long, _start long")
    # One row per partition of the table: its size is bounded by the plan, not by the data.
    out = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    local = F.col("_at") - F.shiftleft(F.col("_part"), _LOCAL_BITS)
    return out.withColumn("rank", F.col("_start") + local).drop("_at", "_part", "_start"), total


def shard_by_curve(docs: DataFrame, shards: int = 8) -> DataFrame:
    """All documents cut into ``shards`` runs of the curve; see :func:`op5_sharding_hilbert` for the columns."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    store, text = Store(spark, "hilbert"), ["size", "text_crc32", "text_hash"]
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.col("text").isNull(), "text").alias("text_hash"),
        quantise_category(F.col("lang")).alias("cell_lang"), quantise_category(F.col("source")).alias("cell_source"),
    )
    narrow = store.put(narrow, "narrow")
    least = F.min(F.struct("doc_id", "cell_lang", "cell_source"))
    groups = store.put(narrow.groupBy(*text).agg(F.count(F.lit(1)).alias("members"), least.alias("least")).filter("members > 1").select(*text, "members", "least.cell_lang", "least.cell_source"), "groups")
    large = F.col("members") * HEAVY >= narrow.count()
    bare = narrow.drop("cell_lang", "cell_source")
    heavy = F.broadcast(groups.filter(large).drop("members"))
    rest = narrow.join(heavy.select(*text), text, "left_anti")
    light = groups.filter(~large).select(*text, F.col("cell_lang").alias("group_lang"), F.col("cell_source").alias("group_source"))
    rest = rest.join(light, text, "left").withColumn("cell_lang", F.coalesce("group_lang", "cell_lang")).withColumn("cell_source", F.coalesce("group_source", "cell_source"))
    placed = bare.join(heavy, text).unionByName(rest.drop("group_lang", "group_source")).withColumn("cell_size", quantise_size(F.col("size")))
    indexed = with_hilbert_index(placed, ["cell_source", "cell_lang", "cell_size"])
    rows, total = ranked(indexed, ["curve_index", *text, "doc_id"], store)
    shard = F.expr(f"(rank * {shards}) div {max(total, 1)}")
    first = F.expr(f"({max(total, 1)} * shard + {shards - 1}) div {shards}")
    out = rows.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("rank") - first)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve_index", "cell_source", "cell_lang", "cell_size")


def run_ranges(sharded: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Per shard the row count and each dimension's least and greatest value, for pruning."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for d in dims:
        aggs += [F.min(d).alias(f"min_{d}"), F.max(d).alias(f"max_{d}")]
    return sharded.groupBy("shard").agg(*aggs)


def prune(ranges: DataFrame, **bounds: tuple) -> DataFrame:
    """Shards whose ranges meet every given (low, high) box side; others cannot hold a match."""
    for d, (low, high) in bounds.items():
        ranges = ranges.filter((F.col(f"max_{d}") >= low) & (F.col(f"min_{d}") <= high))
    return ranges.select("shard")


def op5_sharding_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 8 Hilbert runs of equal row counts."""
    return shard_by_curve(read_table(spark, sf_dir, "documents"))
