"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed as k-grams; of every window of
consecutive k-grams the least hash is kept as the window's fingerprint.  A
window of w words holds w - k + 1 k-grams and is its own winnowing window, so
equal windows keep equal fingerprints: every shared span of w words or more is
met (the guarantee of winnowing).  Training fingerprints pass a bitmap of the
benchmark's, of fixed size; a hit is then extended to both sides over the whole
window around it, as a 128-bit digest of its words, and joined with the
benchmark's windows.  Overlapping windows unite to longer spans.

An item of fewer than w words is one window, met in the same way with windows
of its own length; an item without words has none.

Nulls: a null text has no words; a null document key is kept as null; a null
item key counts as the empty string.  Repeated document rows are reported one
by one; rows of an item that repeats its key count as one item.  Very long
texts are read whole.  An empty table on either side leaves every document
clean.  Other columns are dropped.

Words of one document and items of one window are the only groups: the first is
bounded by the text, the second is what the digest of an item list needs.  It
is built once for each set of windows' item lists, however many documents hold
it; windows that many documents share are joined by broadcast (``lookup``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import Store
from .arrow_tools import bounded_slices, utf8_of
from .lookups import FILTER_BITS, lookup, membership_bits
from .tables import read_table
from .textops import LETTERS, LOWER, Words, mix64, words_of

WINDOW, GRAM = 10, 5
_KEEP = bytes(LOWER)


def fingerprints(words: Words, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(first word, fingerprint) of every window of ``window`` words within one document."""
    k, n = min(gram, window), len(words.hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        rolled += words.hash[j : n - k + 1 + j] * (mix64(np.array([window * 64 + j + 1], np.uint64))[0] | np.uint64(1))
    rolled = mix64(rolled)
    # Least of window - k + 1 neighbours: runs of doubled length, then two that overlap.
    least, size, span = rolled, 1, window - k + 1
    while 2 * size <= span:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    inside = np.nonzero(words.doc[: n - window + 1] == words.doc[window - 1 :])[0]
    return inside, least[inside]


def window_digests(words: Words, starts: np.ndarray, window: int) -> list[bytes]:
    """128-bit digests of the lower-cased words of windows, joined by spaces."""
    low = words.raw.tobytes().translate(_KEEP)
    pieces = [low[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)] if len(starts) * window > len(words.start) else None
    out = []
    for s in starts.tolist():
        own = pieces[s : s + window] if pieces else [low[a:b] for a, b in zip(words.start[s : s + window].tolist(), words.end[s : s + window].tolist(), strict=True)]
        out.append(hashlib.blake2b(b" ".join(own), digest_size=16).digest())
    return out


def benchmark_windows(items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item, length, place, digest): the windows of every item; ``place`` is the fingerprint's bit of the filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            ids, words = b.column("item"), words_of(utf8_of(b), LETTERS)
            sizes = np.bincount(words.doc, minlength=b.num_rows)
            for length in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
                at, prints = fingerprints(words, length)
                if length < window:  # an item of its own length is one window
                    whole = sizes[words.doc[at]] == length
                    at, prints = at[whole], prints[whole]
                columns = [ids.take(pa.array(words.doc[at])), pa.array(np.full(len(at), length, np.int32)), pa.array((prints % np.uint64(FILTER_BITS)).astype(np.int64)), pa.array(window_digests(words, at, length), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "length", "place", "digest"])

    item = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item")
    return items.select(item, F.col(text).alias("text")).mapInArrow(run, "item string, length int, place long, digest binary")


def fingerprint_hits(docs: DataFrame, bits: np.ndarray, lengths: Sequence[int]) -> DataFrame:
    """(row, doc_id, n_words, hits): per document the windows whose fingerprint is in the filter, as (first word, length, digest)."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS / 8 bytes
    kind = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            words = words_of(utf8_of(b), LETTERS)
            sizes = np.bincount(words.doc, minlength=b.num_rows)
            first = np.concatenate([[0], np.cumsum(sizes)])
            found: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for length in lengths:
                at, prints = fingerprints(words, length)
                # Neighbouring windows mostly keep the same k-gram: it is asked for once.
                fresh = np.concatenate([[True], prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, bool)
                place = (prints[fresh] % np.uint64(FILTER_BITS)).astype(np.int64)
                at = at[(shared.value[place >> 6] >> (place & 63) & 1 == 1)[np.cumsum(fresh) - 1]] if len(at) else at
                owner = words.doc[at]
                for d, start, digest in zip(owner.tolist(), (at - first[owner]).tolist(), window_digests(words, at, length), strict=True):
                    found[d].append({"start": start, "length": length, "digest": digest})
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(kind))], ["row", "doc_id", "n_words", "hits"])

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "row long, doc_id long, n_words long, hits array<struct<start:int,length:int,digest:binary>>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): per document the figures of :func:`op11_decontamination`; per maximal hit span (row, doc_id, first word, words)."""
    store = Store(docs.sparkSession, "decontamination")
    windows = store.put(benchmark_windows(items, window), "windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())  # window of them at most
    scanned = store.put(fingerprint_hits(docs, membership_bits(windows, "place"), lengths), "scanned")
    hits = store.put(scanned.select("row", "doc_id", F.explode("hits").alias("h")).select("row", "doc_id", "h.*"), "hits")
    met = windows.join(hits.select("digest").distinct(), "digest", "left_semi")
    listed = met.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Windows with the same items are one class; documents carry classes.
    listed = store.put(listed.withColumn("class", F.sha2(F.to_json("items"), 256)), "listed")
    classes = listed.groupBy("class").agg(F.first("items").alias("items"))
    spans = store.put(lookup(hits, listed.select("digest", "class"), "digest", store, "hot-windows").select("row", "doc_id", "start", "length", "class"), "spans")
    by_place = Window.partitionBy("row").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    before = F.max(end).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (before < F.col("start"))).cast("int")
    runs = spans.select("row", "doc_id", "start", end.alias("end"), "length", fresh.alias("fresh")).withColumn("run", F.sum("fresh").over(by_place))
    maximal = runs.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("first_word"), F.max("end").alias("end"))
    maximal = store.put(maximal.select("row", "doc_id", F.col("first_word").cast("long"), (F.col("end") - F.col("first_word")).cast("long").alias("words")), "maximal")
    held = spans.select("row", "class").distinct().groupBy("row").agg(F.array_sort(F.collect_list("class")).alias("classes"))
    held = store.put(held.withColumn("signature", F.sha2(F.concat_ws(",", "classes"), 256)), "held")
    # Item lists are united once for each set of classes that occurs.
    sets = held.groupBy("signature").agg(F.first("classes").alias("classes")).select("signature", F.explode("classes").alias("class"))
    united = sets.join(classes, "class").select("signature", F.explode("items").alias("item")).groupBy("signature").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = united.select("signature", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    by_row = lookup(held.select("row", "signature"), named, "signature", store, "hot-signatures").select("row", "n_items", "items_sha256")
    totals = maximal.groupBy("row").agg(F.sum("words").alias("n_hit")).join(by_row, "row")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = scanned.select("row", "doc_id", "n_words").join(totals, "row", "left")
    zero = F.lit(0).cast("long")
    out = out.select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))
    return out, maximal


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie in windows of ten words of a benchmark item."""
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))[0]


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: The same result by definition, for DuckDB: every window of a document against every window of an item.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM items),
places AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
met AS (SELECT r, i, p.n, item FROM places p JOIN items t ON t.n = p.n AND t.words = array_to_string(p.w[p.i : p.i + p.n - 1], ' ')),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM met) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
