"""Mixing sources to target weights by drawing fixed-length blocks.

Each source's documents, in key order, form one stream of words cut into
blocks of ``BLOCK_WORDS``.  Output slots are grouped into shards; a shard's
counts per source are a multinomial draw conditioned on the sources' totals
(drawn by recursive halving), so totals are met exactly.  A source's slots run
through pseudorandom permutations of its block indexes, one per pass, and the
slots are joined with the blocks by index.

Null sources form one source, ordered last; null keys come first in their
source; null texts have no words; repeated rows are separate documents, and
rows with one source and key are ordered by their texts' hashes, so reruns
agree; very long texts are many blocks; empty tables give empty results; other
columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import Store
from .arrow_tools import bounded_slices
from .tables import read_table
from .textops import SPACES

BLOCK_WORDS = 512
SHARE = 1.5
PASSES = 2
WEIGHTS = (5, 2, 1)
SEED = 20_240_501
SHARD_SLOTS = 4096
MAX_SHARDS = 1 << 16
#: What the generator's own hypergeometric draws take at most, and the widest table of probabilities.
DRAW_LIMIT, WIDEST = 10**9, 1 << 22
#: Fixed value: what the contract counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, limit: float = PASSES) -> list[float]:
    """Shares of ``share`` times all sizes by weight, each at most ``limit`` times its size; excess goes to the rest by weight."""
    total, result, free = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while free:
        scale = total / sum(weights[i] for i in free)
        over = [i for i in free if scale * weights[i] > limit * sizes[i]]
        for i in over or free:
            result[i] = float(limit * sizes[i]) if over else scale * weights[i]
        if not over:
            break
        total -= sum(result[i] for i in over)
        free = [i for i in free if i not in over]
    return result


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1, or its inverse: a four-round Feistel network walked back into range."""
    if n <= 1:
        return np.zeros_like(index)
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    salts = [np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for r in range(4)]
    out = index.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for salt in reversed(salts) if inverse else salts:
            if inverse:
                left, right = right ^ (_mix64(left + salt) & mask), left
            else:
                left, right = right, left ^ (_mix64(right + salt) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class SourcePlan:
    """One source: its words, target, blocks, and how many slots draw from it."""

    words: int
    target: float
    goal: int
    blocks: int
    draws: int
    last_words: int
    key: int


def plan_source(words: int, target: float, key: int, block: int = BLOCK_WORDS) -> SourcePlan:
    """Draws that take exactly the rounded target: all slots take whole blocks but the last, which may take a part."""
    goal, blocks = round(target), -(-words // block)
    if not goal or not blocks:
        return SourcePlan(words, target, 0, blocks, 0, 0, key)
    tail = words - (blocks - 1) * block
    # Slots at which the short last block comes up, one per pass.
    last = np.array([blocks - 1])
    tail_slots = [p * blocks + int(permuted(last, blocks, key * PASSES + p, inverse=True)[0]) for p in range(PASSES)]
    after = lambda d: d * block - (block - tail) * sum(s < d for s in tail_slots)  # noqa: E731  words of the first d slots
    low, high = 1, PASSES * blocks
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if after(mid) >= goal else (mid + 1, high)
    return SourcePlan(words, target, goal, blocks, low, goal - after(low - 1), key)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` items drawn without return are good, for any number of items.

    Above the generator's own limit the probabilities around the mean, built
    from their ratios, are inverted; where even those are too many (a deviation
    of some 10^5 and more) a rounded normal draw differs from them by less
    than one part in 10^5.
    """
    if good + bad < DRAW_LIMIT:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    total, low, high = good + bad, max(0, n - bad), min(n, good)
    share = good / total
    middle, deviation = n * share, np.sqrt(n * share * (1 - share) * (total - n) / (total - 1))
    first, last = max(low, int(middle - 12 * deviation) - 20), min(high, int(middle + 12 * deviation) + 20)
    if last - first > WIDEST:
        return int(np.clip(round(rng.normal(middle, deviation)), low, high))
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    heights = np.concatenate([[0.0], np.cumsum(steps)])
    chance = np.cumsum(np.exp(heights - heights.max()))
    return first + int(np.searchsorted(chance, rng.random() * chance[-1], side="right"))


def draw_counts(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """``n`` items drawn without return from sources that have so many: one source after the other."""
    out, rest = np.zeros_like(have), int(have.sum())
    for i, mine in enumerate(have.tolist()):
        rest -= mine
        out[i] = hypergeometric(rng, mine, rest, n)
        n -= int(out[i])
    return out


def shard_counts(draws: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots per shard and source: multinomial draws conditioned on the totals, by recursive halving of the shard range."""
    total = sum(draws)
    bounds = [total * i // shards for i in range(shards + 1)]
    level = [(0, shards, np.array(draws, np.int64))]
    out = np.zeros((shards, len(draws)), np.int64)
    while level:
        after = []
        for lo, hi, have in level:
            if hi - lo == 1:
                out[lo] = have
                continue
            mid = (lo + hi) // 2
            take = draw_counts(np.random.default_rng([seed, lo, hi]), have, bounds[mid] - bounds[lo])
            after += [(lo, mid, take), (mid, hi, have - take)]
        level = after
    return out


def _slots(spark: SparkSession, plans: list[SourcePlan], seed: int) -> DataFrame:
    """(src, block, slot, shard, words): every output slot and the block it draws; words is how many it takes at most."""
    total = sum(p.draws for p in plans)
    shards = max(1, min(MAX_SHARDS, -(-total // SHARD_SLOTS)))
    counts = shard_counts([p.draws for p in plans], shards, seed)
    first = np.cumsum(counts, 0) - counts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                for s, p in enumerate(plans):
                    for lo in range(int(first[shard, s]), int(first[shard, s] + counts[shard, s]), 1 << 16):
                        slot = np.arange(lo, min(lo + (1 << 16), int(first[shard, s] + counts[shard, s])))
                        block = np.empty_like(slot)
                        for e in range(PASSES):
                            on = slot // p.blocks == e
                            block[on] = permuted(slot[on] - e * p.blocks, p.blocks, p.key * PASSES + e)
                        words = np.where(slot == p.draws - 1, p.last_words, BLOCK_WORDS)
                        columns = [np.full(len(slot), s, np.int32), block, slot, np.full(len(slot), shard, np.int32), words]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["src", "block", "slot", "shard", "words"])

    tasks = max(1, min(shards, -(-total // (16 * SHARD_SLOTS))))
    return spark.range(0, shards, 1, tasks).mapInArrow(run, "src int, block long, slot long, shard int, words long")


@dataclass
class Mix:
    """A planned mix: streams of documents, drawn stretches, the sources' plans, and (row_id, size, row) of whole rows if asked for."""

    streams: DataFrame
    drawn: DataFrame
    plans: list[SourcePlan]
    rows: DataFrame | None = None


def plan_mix(docs: DataFrame, seed: int = SEED, keep_rows: bool = False) -> Mix:
    """Lay out the streams, plan the sources and join slots with blocks.

    ``streams``: row_id, doc_id, source, size, src, start (words before it in its source).
    ``drawn``: row_id, src, slot, shard, lo, hi: words lo to hi of the document are taken by that slot.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "mixing")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"), *([F.struct(*docs.columns).alias("row")] if keep_rows else []))
    order = [F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("text_hash")]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row_id", F.monotonically_increasing_id())

    def running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = object(), 0
        for b in batches:
            starts = []
            for source, size in zip(b.column("source").to_pylist(), b.column("size").to_pylist(), strict=True):
                if source != last:
                    last, before = source, 0
                starts.append(before)
                before += size
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64())], [*b.schema.names, "local_start"])

    # Whole rows are written beside their row_id, which no second reading of the documents would give again.
    placed = store.put(placed.mapInArrow(running, StructType([*placed.schema, StructField("local_start", LongType())])), "placed")
    rows = placed.select("row_id", "size", "row") if keep_rows else None
    placed = placed.drop("row")
    # A partition is a stretch of the source order, so there are at most partitions + sources sums.
    sums = placed.groupBy(F.shiftright("row_id", 33).alias("part"), "source").agg(F.sum("size").alias("words")).collect()
    names = sorted({r.source for r in sums}, key=lambda s: (s is None, s or ""))
    sizes, starts = [0] * len(names), []
    for r in sorted(sums, key=lambda r: r.part):
        s = names.index(r.source)
        starts.append((r.part, s, r.source, sizes[s]))
        sizes[s] += r.words
    weights = [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(names))]
    plans = [plan_source(w, t, seed + i) for i, (w, t) in enumerate(zip(sizes, targets(sizes, weights), strict=True))]
    offsets = spark.createDataFrame(starts, "part long, src int, source string, source_start long")
    on = (F.shiftright("row_id", 33) == offsets.part) & placed.source.eqNullSafe(offsets.source)
    streams = placed.join(F.broadcast(offsets), on).select("row_id", "doc_id", placed.source, "size", "src", (F.col("source_start") + F.col("local_start")).alias("start"))
    n = F.lit(BLOCK_WORDS).cast("long")
    blocks = streams.filter("size > 0").select("row_id", "src", "size", "start", F.explode(F.expr(f"sequence(start div {BLOCK_WORDS}, (start + size - 1) div {BLOCK_WORDS})")).alias("block"))
    # The planner takes the generated slots for a handful of rows; both sides grow with the corpus.
    joined = blocks.join(_slots(spark, plans, seed).hint("merge"), ["src", "block"])
    lo = F.greatest(F.col("start"), F.col("block") * n)
    hi = F.least(F.col("start") + F.col("size"), F.col("block") * n + F.col("words"))
    drawn = joined.filter(hi > lo).select("row_id", "src", "slot", "shard", (lo - F.col("start")).alias("lo"), (hi - F.col("start")).alias("hi"))
    return Mix(streams, drawn, plans, rows)


def taken_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes from it."""
    mix = plan_mix(docs, seed)
    plans = docs.sparkSession.createDataFrame([(i, p.words, p.target) for i, p in enumerate(mix.plans)], "src int, source_size long, target double")
    taken = mix.drawn.groupBy("row_id").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    # One row per source.
    rows = mix.streams.join(F.broadcast(plans), "src").join(taken, "row_id", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _drawn_text(raw: bytes, stretches: list[tuple[int, int]]) -> bytes:
    """The stretches (word lo to word hi) of a text one after the other, with the white space that stands between their words.

    A stretch that does not go on where the one before ended begins a new line.
    """
    full = ~SPACES[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate([[False], full, [False]]).astype(np.int8))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    out, last = [], None
    for lo, hi in stretches:
        if lo == last:
            out.append(raw[end[lo - 1] : end[hi - 1]])
        else:
            out += [b"\n"] * bool(out) + [raw[start[lo] : end[hi - 1]]]
        last = hi
    return b"".join(out)


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents with ``text`` replaced by the words drawn from it, pass after pass; undrawn documents go.

    A document that is taken whole and once keeps its text as it is; of others
    the drawn stretches stay in reading order, white space within them
    included.  Rows are matched by ``row_id``, so null and repeated keys keep
    what was drawn of each.
    """
    mix = plan_mix(docs, seed, keep_rows=True)
    blocks = docs.sparkSession.createDataFrame([(i, p.blocks) for i, p in enumerate(mix.plans)] or [(-1, 1)], "src int, blocks long")
    passes = mix.drawn.join(F.broadcast(blocks), "src").withColumn("turn", F.expr("slot div blocks"))  # one row a source
    picked = passes.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("turn", "lo", "hi"))).alias("taken"))
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Columns are told apart by place, as any name may be among the documents' own.
            row = whole.column(0)
            flat = pa.RecordBatch.from_arrays([*row.flatten(), whole.column(1), whole.column(2)], [str(i) for i in range(len(names) + 2)])
            for b in bounded_slices([flat], str(text_at)):
                columns, new = list(b.columns[:-2]), []
                for text, size, taken in zip(columns[text_at].cast(pa.binary()).to_pylist(), b.columns[-2].to_pylist(), b.columns[-1].to_pylist(), strict=True):
                    stretches = [(t["lo"], t["hi"]) for t in taken]
                    once = stretches[0][0] == 0 and stretches[-1][1] == size and all(x[1] == y[0] for x, y in zip(stretches, stretches[1:], strict=False))
                    new.append(text if once else _drawn_text(text, stretches))
                columns[text_at] = pa.array(new, pa.binary()).cast(pa.string())
                if chars_at is not None:
                    columns[chars_at] = pc.utf8_length(columns[text_at]).cast(columns[chars_at].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return mix.rows.join(picked, "row_id").select("row", "size", "taken").mapInArrow(run, docs.schema)


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed towards their sources' target weights."""
    return taken_words(read_table(spark, sf_dir, "documents"))
