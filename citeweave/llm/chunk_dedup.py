"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest.

A boundary stands where the gear hash of the last ``WINDOW`` bytes is small and
no other such place lies within ``LEAST`` bytes before it.  Both conditions
look only at nearby bytes, so an insertion moves boundaries only next to it.
Stretches of over ``MOST`` bytes without a boundary are cut at least hashes.
Chunks are deduplicated by a digest of 128 bits; consecutive chunks of a
document that also occur in another document form a repeated stretch, reported
from ``MIN_WORDS`` on, in one span for each run of chunks that have the same
first holder.  A passage loses up to a chunk at each end; so where only passages
of some length count, a stretch is held against it together with the words of
the chunks next to it, which loses no such passage.

Offsets are in UTF-8 bytes.  A null text counts as empty and an empty text has
no chunks; very long texts are many chunks.  A row without a key takes no part.  Repeated rows (same key, same
text) count as one document.  The copy kept is the one of the least key, then
the least offset.  Empty tables give empty results; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_tools import bounded_slices, utf8_of
from ..storage import Store
from .tables import read_table
from .textops import SPACES, mix64

WINDOW = 16
MEAN = 16
LEAST = 12
MOST = 256
MIN_WORDS = 11
#: The query reports what may be a passage of over fifty words.
PASSAGE_WORDS = 51
#: Words of a chunk and of its neighbours in one number: none has 2^WORD_BITS.
WORD_BITS = 10
#: One pseudorandom number per byte value.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """Gear hash of the ``WINDOW`` bytes ending at each place, by doubling the window."""
    h, width = GEAR[raw], 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def _long_gaps(h: np.ndarray, start: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Extra boundaries in stretches over ``MOST`` bytes without one, as in text that repeats a few words.

    The cut is at the least hash of the next ``MOST / 4`` places, so after the
    first cut a periodic stretch is cut alike wherever it stands.
    """
    marks = np.union1d(place, start)
    extra, quarter = [], MOST // 4
    for i in np.nonzero(np.diff(marks) > MOST)[0]:
        at, stop = int(marks[i]), int(marks[i + 1])
        while stop - at > MOST:
            at += quarter + int(h[at + quarter : at + 2 * quarter].argmin()) + 1
            extra.append(at)
    return np.array(extra, np.int64)


def chunk_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined bytes, document starts, chunk ends, chunk's document) of all texts; every text ends a chunk."""
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if not len(raw):
        return raw, start, np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gear_hash(raw)
    place = np.nonzero(h < np.uint32((1 << 32) // MEAN))[0] + 1
    doc = np.searchsorted(start, place - 1, side="right") - 1
    inside = place - start[doc] >= WINDOW  # before that the window reaches into another text
    place, doc = place[inside], doc[inside]
    apart = np.ones(len(place), bool)
    apart[1:] = (place[1:] - place[:-1] >= LEAST) | (doc[1:] != doc[:-1])
    place = np.union1d(np.concatenate([place[apart], _long_gaps(h, start, place[apart])]), start[1:][sizes > 0])
    return raw, start, place, np.searchsorted(start, place - 1, side="right") - 1


def _digests(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of byte ranges: polynomials of two primes from prefix sums, mixed with the length."""
    out = []
    for prime, salt in ((0xD1342543DE82EF95, 0), (0xAF251AF3B0F025B5, 0x632BE59BD9B4E019)):
        steps = np.full(len(raw) + 1, pow(prime, -1, 1 << 64), np.uint64)
        steps[0] = 1
        values = mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(salt))[raw] if salt else raw.astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(steps)[:-1])])
        steps[1:] = prime
        out.append(mix64((sums[end] - sums[begin]) * np.cumprod(steps)[end] ^ mix64((end - begin).astype(np.uint64) + np.uint64(salt))))
    return out[0], out[1]


def chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_digest, chunk, start, end, words, d1, d2) of every chunk; words are its own, those of the chunk before and of the one after."""
    names = ["doc_id", "text_digest", "chunk", "start", "end", "words", "d1", "d2"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            texts = utf8_of(b)
            raw, start, end, doc = chunk_ends(texts)
            if not len(end):
                continue
            fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
            begin = np.where(fresh, start[doc], np.concatenate([[0], end[:-1]]))
            full = ~SPACES[raw]
            gap = np.concatenate([[True], ~full[:-1]])
            gap[start[:-1][start[:-1] < len(raw)]] = True  # words never span texts
            word = full & gap
            seen = np.concatenate([[0], np.cumsum(word)])
            first = np.nonzero(fresh)[0]
            number = np.arange(len(end)) - np.repeat(first, np.diff(np.append(first, len(end))))
            whole, _ = _digests(raw, start[:-1], start[1:])
            keys = b.column("doc_id").take(pa.array(doc))
            words = seen[end] - seen[begin]
            before, after = np.where(fresh, 0, np.roll(words, 1)), np.where(np.roll(fresh, -1), 0, np.roll(words, -1))
            words = (before << 2 * WORD_BITS | after << WORD_BITS | words).astype(np.int32)
            d1, d2 = _digests(raw, begin, end)
            columns = [keys, pa.array(whole[doc].view(np.int64)), pa.array(number.astype(np.int32)), pa.array((begin - start[doc])), pa.array(end - start[doc]), pa.array(words), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    return keyed.mapInArrow(run, "doc_id long, text_digest long, chunk int, start long, end long, words int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, passage_words: int = 0) -> DataFrame:
    """One row per stretch of chunks that other documents have too, broken where the least document that has them changes.

    doc_id, start, end, n_words, n_chunks, first_doc_id (least document that has
    each of its chunks), n_copies (least number of copies over its chunks), kept
    (whether this document is that first one).  ``min_words`` holds for the
    stretch as a whole, before it is broken; ``passage_words`` for the stretch
    and the chunks before and after it, hence for the longest passage it may be
    part of.
    """
    store = Store(docs.sparkSession, "chunks")
    all_chunks = chunks(docs)
    digest = ["d1", "d2"]
    shared = all_chunks.groupBy(*digest).agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("copies")).filter("first_doc_id < last")
    shared = store.put(shared.select(*digest, "first_doc_id", "copies"), "shared")
    hits = all_chunks.join(shared, digest).drop(*digest)
    # dense_rank gives repeated rows one place, so they fall into one stretch.
    order = Window.partitionBy("doc_id", "text_digest").orderBy("chunk")
    island = hits.withColumn("island", F.col("chunk") - F.dense_rank().over(order))
    one = island.groupBy("doc_id", "text_digest", "island", "chunk").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.first("words").alias("words"), F.min("first_doc_id").alias("first_doc_id"), F.min("copies").alias("copies"))
    mask = (1 << WORD_BITS) - 1
    before, after = F.shiftrightunsigned("words", 2 * WORD_BITS), F.shiftright("words", WORD_BITS).bitwiseAND(mask)
    one = one.select("*", before.alias("before"), after.alias("after"), F.col("words").bitwiseAND(mask).alias("own"))
    stretch = ["doc_id", "text_digest", "island"]
    whole = Window.partitionBy(*stretch)
    around = F.min_by("before", "chunk").over(whole) + F.max_by("after", "chunk").over(whole)
    long = one.withColumn("all_words", F.sum("own").over(whole)).withColumn("reach", F.col("all_words") + around)
    long = long.filter((F.col("all_words") >= min_words) & (F.col("reach") >= passage_words))
    part = long.withColumn("part", F.col("chunk") - F.row_number().over(Window.partitionBy(*stretch, "first_doc_id").orderBy("chunk")))
    spans = part.groupBy(*stretch, "first_doc_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("own").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"), F.min("copies").alias("n_copies"))
    return spans.select("doc_id", "start", "end", "n_words", "n_chunks", "first_doc_id", "n_copies", (F.col("doc_id") == F.col("first_doc_id")).alias("kept"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents that may be passages of over fifty words which other documents have too."""
    return repeated_spans(read_table(spark, sf_dir, "documents"), passage_words=PASSAGE_WORDS)
