"""N-gram Jaccard join: a size-aware heavy-light set join, with components of linked documents.

Documents are sets of distinct word shingles; two link when
``100 * |A & B| >= 90 * |A | B|``, that is ``19 * |A & B| >= 9 * (|A| + |B|)``.

* Equal sets are folded into one representative first, so a group of copies
  costs one set.
* **Light** sets (size below the boundary) enumerate their fixed-size subsets:
  for every partner size the overlap that a link needs is known, and sharing a
  subset of that size *is* a link, with no further check.
* **Heavy** sets are found by scanning inverted lists.  A list of one shingle
  would grow with every passage that many documents share, so the lists are
  keyed by *blocks* of shingles: linked sets of these sizes differ in at most
  H shingles, so of more than H hash blocks some must agree whole.  A list's
  members are compared with its least member; of lists that still span several
  components after that, the pairs between components that pass two exact
  bounds are compared.  Pairs within a component need no comparison.
* The **boundary** is the size at which the summed cost of enumeration, over
  the corpus's histogram of sizes, first exceeds that of the lists.

Nulls: a null text has no words.  Documents without words have no shingles and
link with nothing, not even each other; those with fewer words than a shingle
have their whole sequence as one.  Repeated rows and equal texts share a
component.  Rows that repeat a key with another text are documents of their
own.  A null key takes part in nothing and is its own (null) component.  Very
long texts are sets like others.  Empty tables give empty results; other
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_tools import bounded_slices, utf8_of
from ..operators.components import connected_components
from ..storage import SHUFFLES, Store
from .tables import read_table
from .textops import mix64, shingles, words_of

SHINGLE = 3
#: Sets up to this size are kept whole by the first pass, as candidates for enumeration.
LIGHT_LIMIT = 40
#: Cost of moving and comparing one shingle of a heavy candidate, in list entries.
VERIFY_COST = 1.0
#: Places of the bitmap that keeps sets nobody asks for out of a shuffle (8 MiB).
FILTER_BITS = 1 << 26
CLASS_RATIO = 1.3
SMALL_CLUSTER = 32
#: Differences from a reference are counted in this many parts, by hash.
PARTS = 16
#: Members of a list that meet in one cell, and members of a cluster beside one copy of its reference.
LIST_PART, CLUSTER_PART = 256, 1024
#: A value held by more than one row in this many is hot, so there are never more hot values than this.
HOT_SHARE = 4096
#: Bytes of text for each part of a shuffle.
SHUFFLE_BYTES = 16 << 20


class Threshold:
    """Link when ``percent``/100 of the union is shared; all arithmetic in integers."""

    def __init__(self, percent: int = 90):
        self.percent = percent

    def overlap(self, n: int, m: int) -> int:
        """Least overlap with which sets of sizes n and m link."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def partners(self, n: int) -> range:
        """Sizes a linked partner can have."""
        return range(-(-self.percent * n // 100), 100 * n // self.percent + 1)

    def difference(self, total: int) -> int:
        """Most shingles in which linked sets of ``total`` summed size differ."""
        return total * (100 - self.percent) // (100 + self.percent)


@cache
def size_classes(percent: int, largest: int) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, blocks, spare blocks) of the heavy classes, up to ``largest``."""
    t, out, low = Threshold(percent), [], 1
    while low <= largest:
        high = max(low, int(low * CLASS_RATIO))
        most = t.difference(2 * high)
        spare = 4 + most // 4
        out.append((low, high, most + 1 + spare, spare))
        low = high + 1
    return out


def block_keys(hashes: np.ndarray, offset: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, document, need) for every block of every set, in its own class and those a larger partner may be in.

    ``need`` is how many of the document's keys of that class a linked partner
    has too: all blocks with shingles but those in which they may differ, and
    at least one.  Blocks without shingles do not count, as the partner may
    leave them out.  The class is in the key's lowest six bits.

    Blocks without shingles are left out unless a document has more of them
    than the spare blocks: of the blocks on which linked sets agree there are
    more than spares, so one of them has shingles in at least one document,
    hence in both.
    """
    t, sizes = Threshold(percent), np.diff(offset)
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    classes = size_classes(percent, int(100 * sizes.max() // percent) + 1)
    lows = np.array([c[0] for c in classes])
    own = np.searchsorted(lows, sizes, side="right") - 1
    reach = np.searchsorted(lows, 100 * sizes // t.percent, side="right") - 1
    keys, docs, needs = [], [], []
    mixed, slot = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), mix64(hashes + np.uint64(0x14057B7EF767814F))
    for up in range(int((reach - own).max(initial=0)) + 1):
        chosen = np.nonzero((sizes > 0) & (own + up <= reach))[0]
        if not len(chosen):
            continue
        kind = own[chosen] + up
        blocks = np.array([c[2] for c in classes])[kind]
        spare = np.array([c[3] for c in classes])[kind]
        base = np.concatenate([[0], np.cumsum(blocks)])
        pick = np.repeat(np.arange(len(chosen)), sizes[chosen])
        at = np.arange(len(pick)) - np.repeat(np.cumsum(sizes[chosen]) - sizes[chosen], sizes[chosen]) + offset[chosen][pick]
        place = base[pick] + (slot[at] % blocks[pick].astype(np.uint64)).astype(np.int64)
        sums, filled = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
        np.add.at(sums, place, mixed[at])
        filled[place] = True
        owner = np.repeat(np.arange(len(chosen)), blocks)
        number = np.arange(base[-1]) - base[:-1][owner]
        empty = blocks - np.add.reduceat(filled.astype(np.int64), base[:-1])
        use = filled | (empty > spare)[owner]
        tag = (kind[owner] * (1 << 32) + number).astype(np.uint64)
        hashed = mix64(mix64(sums + np.uint64(1)) ^ mix64(tag))
        keys.append(((hashed & ~np.uint64(63)) | (kind[owner] & 63).astype(np.uint64))[use])
        docs.append(chosen[owner[use]])
        needs.append(np.maximum(blocks - empty - (blocks - 1 - spare), 1)[owner[use]])
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(needs)


def sketch_sets(hashes: np.ndarray, offset: np.ndarray) -> list[bytes | None]:
    """Per set how many shingles fall into each of 2^b buckets, about two in each; None where a count passes a byte."""
    sizes = np.diff(offset)
    if not len(sizes):
        return []
    width = 1 << np.ceil(np.log2(np.maximum(sizes / 2, 16))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = base[owner] + (mix64(hashes ^ np.uint64(0x2545F4914F6CDD1D)).view(np.int64) & (width[owner] - 1))
    counts = np.bincount(place, minlength=base[-1])
    raw = np.minimum(counts, 255).astype(np.uint8).tobytes()
    most = np.maximum.reduceat(counts, base[:-1])
    return [raw[base[i] : base[i + 1]] if most[i] <= 255 else None for i in range(len(sizes))]


def shared_bound(x: bytes, y: bytes) -> int:
    """No two sets with these sketches share more shingles than this."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    if len(a) < len(b):
        a, b = b, a
    return int(np.minimum(a.reshape(-1, len(b)).sum(0), b).sum())


def subset_keys(shingle_hashes: list[int], percent: int, boundary: int) -> list[tuple[int, bool]]:
    """(key, sizes differ) of the fixed-size subsets of a light set, for every partner size below the boundary."""
    t, n, wrap = Threshold(percent), len(shingle_hashes), (1 << 64) - 1
    mixed = mix64(np.array(shingle_hashes, np.int64).view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)).tolist()
    total, out = sum(mixed) & wrap, []
    for m in t.partners(n):
        need = t.overlap(n, m)
        if m >= boundary or need > min(n, m) or need == n == m:
            continue
        for gone in combinations(mixed, n - need):
            out.append(((total - sum(gone)) & wrap, min(n, m), max(n, m)))
    if not out:
        return []
    low = np.array([o[1] * 4096 + o[2] for o in out], np.uint64)
    keys = mix64(mix64(np.array([o[0] for o in out], np.uint64)) ^ mix64(low + np.uint64(1 << 60))).view(np.int64).tolist()
    return [(k, o[1] != o[2]) for k, o in zip(keys, out, strict=True)]


def choose_boundary(histogram: dict[int, int], percent: int, limit: int = LIGHT_LIMIT) -> int:
    """The size at which the cost of subsets below plus lists above is least."""
    t = Threshold(percent)
    largest = max(histogram, default=1)
    classes = size_classes(percent, 100 * largest // percent + 1)
    lists = lambda n: sum(c[2] for c in classes if c[0] <= 100 * n // percent and c[1] >= n) + VERIFY_COST * n

    def subsets(n: int, boundary: int) -> int:
        sizes = [m for m in t.partners(n) if m < boundary and t.overlap(n, m) <= min(n, m) and not t.overlap(n, m) == n == m]
        return sum(comb(n, n - t.overlap(n, m)) for m in sizes)

    def cost(boundary: int) -> float:
        light = sum(c * subsets(n, boundary) for n, c in histogram.items() if n < boundary)
        return light + sum(c * lists(n) for n, c in histogram.items() if 100 * n // percent >= boundary)

    return min(range(1, limit + 2), key=lambda b: (cost(b), -b))


def shingle_sets(docs: DataFrame, size: int = SHINGLE, percent: int = 90) -> DataFrame:
    """doc_id, text_hash, n, s1, s2 (a digest of the set), small (the set, if at most LIGHT_LIMIT), blocks (heavy list keys), needs, sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            hashes, offset = shingles(words_of(utf8_of(b)), b.num_rows, size)
            n = np.diff(offset)
            sums = np.concatenate([np.zeros((1, 2), np.uint64), np.cumsum(np.stack([mix64(hashes + np.uint64(3)), mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], 1), 0, dtype=np.uint64)])
            digest = (sums[offset[1:]] - sums[offset[:-1]]).view(np.int64)
            keys, owner, needs = block_keys(hashes, offset, percent)
            order = np.argsort(owner, kind="stable")
            counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b.num_rows))])
            blocks = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(keys[order].view(np.int64)))
            needed = pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(needs[order].astype(np.int32)))
            few = n <= LIGHT_LIMIT
            small = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(few, n, 0))]), pa.int32()), pa.array(hashes[np.repeat(few, n)].view(np.int64)))
            columns = [b.column("doc_id"), b.column("text_hash"), pa.array(n), pa.array(digest[:, 0]), pa.array(digest[:, 1]), small, blocks, needed, pa.array(sketch_sets(hashes, offset), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "s1", "s2", "small", "blocks", "needs", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, s1 long, s2 long, small array<long>, blocks array<long>, needs array<int>, sketch binary")


def _light_entries(reps: DataFrame, percent: int, boundary: int) -> DataFrame:
    """(key, rep, n, differ) of all subsets of light sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, r, n, d) for r, n, s in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("small").to_pylist(), strict=True) for k, d in subset_keys(s, percent, boundary)]
            for at in range(0, len(rows), 1 << 16):
                part = list(zip(*rows[at : at + (1 << 16)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, [pa.int64(), pa.int64(), pa.int64(), pa.bool_()], strict=True)], ["key", "rep", "n", "differ"])

    return reps.filter((F.col("n") > 0) & (F.col("n") < boundary)).select("doc_id", "n", "small").mapInArrow(run, "key long, rep long, n long, differ boolean")


def _membership_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of ``FILTER_BITS`` places with those of all ids set.

    Its size is fixed; the more ids there are, the more others it lets through,
    and the join that follows is exact either way.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {FILTER_BITS}) % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return bits


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(rep, items) of the wanted nodes, rebuilt from their texts."""
    bits = docs.sparkSession.sparkContext.broadcast(_membership_bits(wanted))  # FILTER_BITS / 8 bytes

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            place = b.column("place").to_numpy()
            b = b.filter(pa.array((bits.value[place >> 6] >> (place & 63) & 1) == 1))
            if b.num_rows:
                hashes, offset = shingles(words_of(utf8_of(b)), b.num_rows, size)
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.ListArray.from_arrays(pa.array(offset, pa.int32()), pa.array(hashes.view(np.int64)))], ["rep", "items"])

    keyed = docs.select(F.col("node").alias("rep"), F.coalesce("text", F.lit("")).alias("text")).filter("rep is not null")
    sets = keyed.withColumn("place", F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))).mapInArrow(run, "rep long, items array<long>")
    return sets.join(wanted, "rep", "left_semi").dropDuplicates(["rep"])


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow a link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                columns = [b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")]
                keep = [x is None or y is None or (100 + percent) * shared_bound(x, y) >= percent * (n + m) for n, m, x, y in zip(*columns, strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            pa.default_memory_pool().release_unused()

    left = sketches.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("xa"))
    right = sketches.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("xb"))
    sized = pairs.join(left, "a").join(right, "b").filter(f"100 * na >= {percent} * nb and 100 * nb >= {percent} * na")
    return sized.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, sketches: DataFrame, size: int, percent: int, store: Store, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link; sets are built, once each, only where the sketches allow a link."""
    pairs = store.put(_possible(pairs, sketches, percent), f"{name}-possible")
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = store.put(_sets_of(docs, ids, size), f"{name}-sets")
    left = sets.select(F.col("rep").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    linked = pairs.join(left, "a").join(right, "b").filter((100 + percent) * shared >= percent * (F.size("x") + F.size("y")))
    found = store.put(linked.select("a", "b"), f"{name}-linked")
    store.drop(f"{name}-sets", f"{name}-possible")
    return found


def _with_enough(entries: DataFrame) -> DataFrame:
    """The entries (rep, kind, need, ...) of documents that have at least as many of a kind as a linked partner shares."""
    enough = entries.groupBy("rep", "kind").agg(F.count(F.lit(1)).alias("c"), F.min("need").alias("least")).filter("c >= least").select("rep", "kind")
    return entries.join(enough, ["rep", "kind"], "left_semi")


def _in_groups(rows: DataFrame, on: list[str], facts: list, chosen: str, store: Store, name: str) -> DataFrame:
    """The rows of a stored table whose group by ``on`` meets ``chosen``, a condition on its ``members`` and ``facts``.

    No group is brought together: it is judged by aggregates that combine
    before the shuffle, hot values (``HOT_SHARE`` at most) are broadcast to
    their rows, and only the others' rows are dealt by value.
    """
    groups = store.put(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("members"), *facts).filter(chosen).select(*on, "members"), name)
    cut = rows.count() // HOT_SHARE
    hot = F.broadcast(groups.filter(F.col("members") > cut).select(*on)) if cut else None
    if hot is None:
        return rows.join(groups.select(*on), on, "left_semi")
    cold = rows.join(hot, on, "left_anti").join(groups.filter(F.col("members") <= cut).select(*on), on, "left_semi")
    return rows.join(hot, on, "left_semi").unionByName(cold)


def _parts_of(members: str, size: int) -> Column:
    """How many parts of about ``size`` so many members make."""
    return F.ceil(F.col(members) / size).cast("int")


def _cross_pairs(still: DataFrame, docs: DataFrame, size: int, percent: int, store: Store) -> DataFrame:
    """Pairs (a, b) of documents of different components that may link, from open lists (key, rep, kind, need, component).

    Exact bounds thin them out before any pair is formed:

    * A document whose shingles outside its own component cover less than
      ``percent`` of it links with nothing outside.
    * Linked documents share at least ``need`` of their keys, so they meet in a
      list even if each enters only its m - need + 1 shortest of m lists.
    * Lists that share members form clusters.  Relative to one reference of
      its cluster a document is its difference D from that.  Linked a and b
      share at least (|Da| + |Db| - H) / 2 shingles of D, where H bounds how
      much linked sets of their sizes differ; and in each of ``PARTS`` parts
      of D they can share no more than either has in common with any other
      member of the cluster.  Clusters of at most ``SMALL_CLUSTER`` members do without.
    """
    ids = still.select("rep", "component").distinct()
    sets = store.put(_sets_of(docs, ids.select("rep"), size), "open-sets")
    token = store.put(ids.join(sets, "rep").select("rep", "component", F.size("items").alias("n"), F.explode("items").alias("t")), "open-tokens")
    outside = _in_groups(token, ["t"], [F.min("component").alias("c0"), F.max("component").alias("c1")], "c0 < c1", store, "open-shared")
    live = outside.groupBy("rep").agg(F.count(F.lit(1)).alias("out"), F.first("n").alias("n")).filter(F.col("out") * 100 >= F.col("n") * percent).select("rep", "n")
    live = store.put(live, "live")
    store.drop("open-tokens", "open-shared")

    entry = _with_enough(still.join(live, "rep"))
    leads = entry.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("length"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("key", "lead", "length")
    entry = _with_enough(entry.join(leads, "key"))
    own = Window.partitionBy("rep", "kind")
    entry = entry.withColumn("i", F.row_number().over(own.orderBy("length", "key"))).withColumn("all", F.count(F.lit(1)).over(own)).filter("i <= all - need + 1")
    entry = store.put(entry.select("key", "rep", "component", "n", "lead", "length"), "open-entries")
    cluster = connected_components(entry.select(F.col("rep").alias("a"), F.col("lead").alias("b")), store, "open").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    # A cluster's reference is its member in most lists.
    weight = entry.groupBy("rep").agg(F.count(F.lit(1)).alias("w")).join(cluster, "rep")
    r = weight.groupBy("cluster").agg(F.max_by("rep", F.struct("w", -F.col("rep"))).alias("r"))
    item, other = sets.select("rep", F.col("items").alias("x")), sets.select(F.col("rep").alias("r"), F.col("items").alias("y"))
    large = cluster.groupBy("cluster").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > SMALL_CLUSTER).join(r, "cluster")
    # One copy of the reference for each part of a cluster.
    copies = large.join(other, "r").select("r", "y", F.explode(F.sequence(F.lit(0), _parts_of("members", CLUSTER_PART) - 1)).alias("part"))
    member = cluster.join(large, "cluster").select("rep", "r", F.pmod(F.xxhash64("rep"), _parts_of("members", CLUSTER_PART)).cast("int").alias("part"))
    differing = F.explode(F.concat(F.array_except("x", "y"), F.array_except("y", "x")))
    apart = store.put(member.join(copies, ["r", "part"]).join(item, "rep").select("r", "rep", differing.alias("t")), "differences")
    shared = _in_groups(apart, ["r", "t"], [], "members > 1", store, "common-differences")
    # The reference itself differs in nothing, and members of small clusters are not measured: no bound holds them back.
    parts = [f"g{i}" for i in range(PARTS)]
    met = shared.groupBy("rep").agg(*(F.count(F.when(F.pmod(F.col("t"), F.lit(PARTS)) == i, 1)).alias(g) for i, g in enumerate(parts)))
    measure = apart.groupBy("rep").agg(F.count(F.lit(1)).alias("d")).join(met, "rep", "left").na.fill(0, parts)
    placed = store.put(entry.join(measure, "rep", "left").select("key", "rep", "component", "n", "d", *parts, "length"), "measured")
    store.drop("differences", "common-differences")
    # A long list is cut into parts, and each pair of parts is a cell of its own.
    fields = ("rep", "component", "n", "d", *parts)
    cells = placed.withColumn("of", _parts_of("length", LIST_PART)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("of")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("of") - 1))
    one = cells.select("key", F.col("own").alias("p"), every.alias("q"), *(F.col(c).alias(f"{c}b") for c in fields))
    two = cells.select("key", every.alias("p"), F.col("own").alias("q"), *(F.col(c).alias(f"{c}a") for c in fields))
    differ = f"((na + nb) * {100 - percent} div {100 + percent})"
    common = " + ".join(f"least({g}a, {g}b)" for g in parts)
    near = f"componenta <> componentb and repb < repa and (da is null or db is null or da + db - {differ} <= 2 * ({common}))"
    return one.join(two, ["key", "p", "q"]).filter(near).select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct()


def _named_apart(base: DataFrame, store: Store) -> DataFrame | None:
    """(doc_id, text_hash, node) of keys that rows with different texts share, each text with a number no key has; None if there are none."""
    keys = base.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("t0"), F.max("text_hash").alias("t1"))
    shared = keys.filter("t0 < t1").select("doc_id")
    if not shared.head(1):
        return None
    low, high = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    node = F.lit(high + 1) + number if high < 1 << 61 else F.lit(low - 1) - number
    return store.put(base.join(shared, "doc_id", "left_semi").select("doc_id", "text_hash").distinct().withColumn("node", node), "apart")


def _parts_for(docs: DataFrame) -> int:
    """Parts of SHUFFLE_BYTES of text."""
    return -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHUFFLE_BYTES)


def _components(docs: DataFrame, size: int, percent: int, store: Store) -> tuple[DataFrame, bool]:
    """(doc_id, text_hash, n, component, component_id) of every row; component is a number of the group, component_id its least key.

    The second value tells whether keys are shared by different texts.
    """
    # Blocks and entries are several times the texts, so parts follow the texts' size.
    store.parts = _parts_for(docs)
    base = store.put(shingle_sets(docs, size, percent), "sets")
    apart = _named_apart(base.select("doc_id", "text_hash"), store)
    own = F.col("doc_id").cast("long")
    if apart is None:
        docs, base = docs.select(own.alias("node"), "text"), base.withColumn("node", F.col("doc_id"))
    else:
        keyed = docs.select(own.alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
        node = F.coalesce("node", "doc_id").alias("node")
        docs = keyed.join(apart, ["doc_id", "text_hash"], "left").select(node, "text")
        base = base.join(apart, ["doc_id", "text_hash"], "left").select(*base.columns, node)
    digest = ["n", "s1", "s2"]
    narrow = store.put(base.select("doc_id", "text_hash", "node", *digest), "narrow")
    # Fold equal sets; the least node stands for all.
    reps = store.put(narrow.filter("n > 0 and doc_id is not null").groupBy(*digest).agg(F.min("node").alias("rep"), F.min("doc_id").alias("least")), "reps")
    histogram = {r.n: r["count"] for r in reps.groupBy(F.least("n", F.lit(LIGHT_LIMIT * 2)).alias("n")).count().collect()}
    boundary = choose_boundary(histogram, percent)
    chosen = store.put(base.join(reps.select(F.col("rep").alias("node"), *digest), ["node", *digest], "left_semi").select(F.col("node").alias("doc_id"), "n", "small", "blocks", "needs", "sketch"), "chosen")
    sketches = store.put(chosen.select(F.col("doc_id").alias("rep"), "n", "sketch"), "sketches")
    store.drop("sets")

    light = store.put(_light_entries(chosen, percent, boundary), "light")
    subsets = light.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("differ").alias("differ"))
    hubs = subsets.filter("lead < last and (not differ or n0 < n1)").select("key", "lead")
    edges = light.join(hubs, "key").filter("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct()
    # Keys are hashes of subsets: what shares one is held against the sets themselves.
    item = chosen.filter(F.col("n") < boundary).select(F.col("doc_id").alias("rep"), "small")
    both = edges.join(item.select(F.col("rep").alias("a"), F.col("small").alias("x")), "a").join(item.select(F.col("rep").alias("b"), F.col("small").alias("y")), "b")
    edges = store.put(both.filter((100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * (F.size("x") + F.size("y"))).select("a", "b"), "light-edges")

    entries = chosen.filter(F.floor(F.col("n") * 100 / percent) >= boundary).select(F.col("doc_id").alias("rep"), F.explode(F.arrays_zip("blocks", "needs")).alias("e")).select("rep", F.col("e.blocks").alias("key"), F.col("e.needs").alias("need"))
    lists = store.put(entries.groupBy("key").count().filter("count > 1").select("key"), "lists")
    store.drop("light")
    # A document with too few of its keys in lists has no partner.
    listed = entries.join(lists, "key").withColumn("kind", F.col("key").bitwiseAND(63))
    listed = store.put(listed, "listed")
    store.drop("chosen", "lists")
    members = store.put(_with_enough(listed).select("key", "rep", "kind", "need"), "members")
    store.drop("listed")
    leads = members.groupBy("key").agg(F.min("rep").alias("lead"))
    others = store.put(members.join(leads, "key").filter("rep <> lead"), "others")
    first = store.put(others.select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), "pairs0")
    store.drop("members")
    edges = store.put(edges.unionByName(_linked(first, docs, sketches, size, percent, store, "star")), "edges0")
    labels = connected_components(edges, store, "cc0")

    # What was compared with a list's least member is settled; of the others, those of several components are compared.
    placed = store.put(others.select("key", "rep", "kind", "need").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "kind", "need", F.coalesce("component", "rep").alias("component")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("key")
    still = store.put(_with_enough(placed.join(open_keys, "key", "left_semi")), "still")
    store.drop("others", "placed")
    crossing = store.put(_cross_pairs(still, docs, size, percent, store).join(first, ["a", "b"], "left_anti"), "pairs1")
    more = _linked(crossing, docs, sketches, size, percent, store, "cross")
    if more.head(1):
        edges = store.put(edges.unionByName(more), "edges1")
        labels = connected_components(edges, store, "cc1")
    store.drop("still", "pairs0", "pairs1", "open-sets", "open-entries", "measured", "live", "sketches")

    named = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*digest, "least", F.coalesce("component", "rep").alias("component"))
    if apart is None:  # nodes are keys, so a component's number is its least key
        named = named.select(*digest, "component", F.col("component").alias("component_id"))
    else:
        named = store.put(named, "named")
        named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select(*digest, "component", "component_id")
    linked = narrow.filter("doc_id is not null and n > 0").join(named, digest, "left")
    alone = narrow.filter("doc_id is null or n = 0").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    fields = ["doc_id", "text_hash", "n", "component", "component_id"]
    return linked.select(*fields).unionByName(alone.select(*fields)), apart is not None


def linked_components(docs: DataFrame, size: int = SHINGLE, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    out, _ = _components(docs, size, percent, Store(docs.sparkSession, "jaccard"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_per_group(docs: DataFrame, size: int = SHINGLE, percent: int = 90) -> DataFrame:
    """One document of each component, that of the least key (then the least text hash); all columns kept.

    Documents without words are linked with nothing and stay, and so does every
    row without a key.  Of rows that repeat key and text one stays; rows that
    repeat a key with another text are documents of their own.
    """
    store = Store(docs.sparkSession, "heads")
    out, shared = _components(docs, size, percent, store)
    rows = store.put(out.filter("doc_id is not null").groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")), "rows")
    least = rows.filter("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("h")).select("component", "h.*")
    heads = rows.filter("component is not null").join(least, ["component", "doc_id", "text_hash"], "left_semi").unionByName(rows.filter("component is null"))
    heads = store.put(heads.select("doc_id", "text_hash", "copies"), "heads")
    # Columns are taken by table, as any name may be among the documents' own.
    if store.parts > int(docs.sparkSession.conf.get(SHUFFLES)):
        # Whoever writes the result may have fewer parts than whole texts need.
        dealt = docs.repartition(store.parts, *([docs["doc_id"].cast("long"), F.xxhash64(docs["text"])] if shared else [docs["doc_id"].cast("long")]))
        heads = heads.repartition(store.parts, *(["doc_id", "text_hash"] if shared else ["doc_id"]))
    else:
        dealt = docs
    on = dealt["doc_id"].cast("long") == heads["doc_id"]
    if shared:
        on = on & (F.xxhash64(dealt["text"]) == heads["text_hash"])
    kept = dealt.join(heads, on, "left_semi")
    if heads.filter("copies > 1").head(1):
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.filter("doc_id is null"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles agree to 90 %."""
    return linked_components(read_table(spark, sf_dir, "documents"))


#: The same result by definition, for DuckDB: all pairs of different sets that share a shingle.
ORACLE = """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s FROM t
), folded AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
g AS (SELECT rep, n, unnest(s) AS shingle FROM folded),
links AS (
  SELECT a.rep AS x, b.rep AS y FROM g a JOIN g b ON a.shingle = b.shingle AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rep, rep FROM folded UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y),
component AS (SELECT x AS rep, min(y) AS least FROM reach GROUP BY x)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(least, sets.doc_id) AS component_id
FROM sets LEFT JOIN folded ON folded.s = sets.s LEFT JOIN component USING (rep)
"""
