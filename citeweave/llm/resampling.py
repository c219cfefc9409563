"""Target-distribution importance resampling over hashed word n-grams.

Identical texts are collapsed by grouping the full text, with their number of
copies.  Each distinct text is cut into features once and stored as sparse
bucket counts; corpus totals are those counts times the copies.  A bucket's
gain is the logarithm of its smoothed share in the target against the corpus,
and a text's weight the sum of its features' gains.  Weights go back to the
documents by the text's digest, and only then comes the noise of each document:
Gumbel noise from a hash of its key, so that taking the highest scores draws
without replacement in proportion to the weights.

Nulls: a null text has no words; a null key stands for the empty string in the
noise and comes first among ties.  Texts without words weigh 0.  Very long
texts are read whole.  Repeated rows are documents of their own; rows that
agree in key and score are ranked in any order.  An empty corpus gives no rows;
an empty target weighs features against the smoothing alone.  Other columns
are dropped.

A text that a third of all rows hold is one group that combines before the
shuffle; its weight reaches its rows by broadcast (``lookup``).  Ranks come from
a range partitioning, with one count a partition at the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Store
from .arrow_tools import bounded_slices, utf8_of
from .hilbert import ranked
from .lookups import lookup
from .tables import read_table
from .textops import LETTERS, LOWER, word_spans

BUCKETS, LONGEST = 10_000, 1
LEAST_WORDS, PERCENT, SEED = 20, 10, 2024
#: Spans up to this many bytes are hashed side by side, longer ones one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def crc32_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of many spans of ``raw``, byte by byte for all spans at once."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    first, sizes = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    longer = np.searchsorted(-sizes, -_SHORT, side="left")
    live = len(order)
    for j in range(int(min(sizes[longer], _SHORT)) if longer < len(order) else 0):
        live = int(np.searchsorted(-sizes[:live], -j, side="left"))
        own = crc[longer:live]
        crc[longer:live] = _CRC[(own ^ raw[first[longer:live] + j]) & 255] ^ (own >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    for i in order[:longer]:
        out[i] = zlib.crc32(raw[start[i] : end[i]])
    return out


def feature_buckets(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, owner) of every feature, repeats included, and each document's number of words."""
    raw, _, start, end, doc = word_spans(texts, LETTERS)
    words = np.bincount(doc, minlength=len(texts))
    low = LOWER[raw]
    if longest > 1 and len(start):  # words side by side with one space between, so that n-grams are spans
        sizes = end - start
        moved = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        joined = np.full(int(sizes.sum() + len(sizes)), 0x20, np.uint8)
        shift = np.repeat(moved - start, sizes)
        at = np.arange(len(shift)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)
        joined[at + shift] = low[at]
        low, start, end = joined, moved, moved + sizes
    found, owners = [], []
    for n in range(1, min(longest, len(start)) + 1):
        inside = doc[: len(doc) - n + 1] == doc[n - 1 :]
        found.append(crc32_spans(low, start[: len(doc) - n + 1][inside], end[n - 1 :][inside]) % np.uint32(buckets))
        owners.append(doc[: len(doc) - n + 1][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), words


def collapsed(docs: DataFrame) -> DataFrame:
    """(text, copies): documents grouped by their full text; null is the empty text."""
    return docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("copies"))


def text_features(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(digest, copies, n_words, n_features, bucket, times): sparse bucket counts of each distinct text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            bucket, owner, words = feature_buckets(utf8_of(b), buckets, longest)
            keys, times = np.unique(owner * buckets + bucket, return_counts=True)
            offset = pa.array(np.searchsorted(keys, np.arange(b.num_rows + 1) * buckets), pa.int32())
            sparse = [pa.ListArray.from_arrays(offset, pa.array(x.astype(np.int32))) for x in (keys % buckets, times)]
            features = np.bincount(owner, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("copies"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), *sparse], ["digest", "copies", "n_words", "n_features", "bucket", "times"])

    keyed = texts.select(_digest(F.col("text")).alias("digest"), "copies", "text")
    return keyed.mapInArrow(run, "digest binary, copies long, n_words long, n_features long, bucket array<int>, times array<int>")


def _digest(text):
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def bucket_totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all copies; a task sends one row a bucket at most, as does the driver's result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for b in batches:
            bucket, times = b.column("bucket"), b.column("times")
            copies = np.repeat(b.column("copies").to_numpy(), np.diff(bucket.offsets.to_numpy()))
            np.add.at(sums, bucket.flatten().to_numpy(), times.flatten().to_numpy() * copies)
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["b", "v"])

    total = np.zeros(buckets, np.int64)
    for r in features.select("copies", "bucket", "times").mapInArrow(run, "b int, v long").groupBy("b").agg(F.sum("v").alias("v")).collect():
        total[r.b] = r.v
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the smoothed shares, rounded down."""
    size, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def text_weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(digest, n_words, n_features, weight) of each distinct text."""
    shared = features.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bucket = b.column("bucket")
            sums = np.concatenate([[0], np.cumsum(shared.value[bucket.flatten().to_numpy()] * b.column("times").flatten().to_numpy())])
            at = bucket.offsets.to_numpy() - bucket.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("digest", "n_words", "n_features")), pa.array(np.diff(sums[at]).astype(np.int64))], ["digest", "n_words", "n_features", "weight"])

    return features.select("digest", "n_words", "n_features", "bucket", "times").mapInArrow(run, "digest binary, n_words long, n_features long, weight long")


def importance(docs: DataFrame, target: DataFrame, store: Store, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    features = store.put(text_features(collapsed(docs), buckets, longest), "features")
    wanted = store.put(text_features(collapsed(target), buckets, longest), "target")
    gain = gains(bucket_totals(features, buckets), bucket_totals(wanted, buckets))
    weights = store.put(text_weights(features, gain), "weights")
    store.drop("features", "target")
    keyed = store.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest")), "keyed")
    return lookup(keyed, weights, "digest", store, "hot").select("doc_id", "n_words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank; documents that are not drawn have no rank."""
    store = Store(docs.sparkSession, "resampling")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = importance(docs, target, store, buckets, longest).withColumn("score", F.col("weight") + noise)
    # The last key deals out rows that agree in all others.
    scored = store.put(scored.select("*", (-F.col("score")).alias("down"), F.monotonically_increasing_id().alias("tie")), "scored")
    rows, total = ranked(scored.filter(F.col("n_words") >= least_words), ["down", "doc_id", "tie"], store)
    place = F.when(F.col("rank") < percent * total // 100, F.col("rank") + 1)
    short = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return rows.withColumn("rank", place.cast("long")).select(*columns).unionByName(short.select(*columns))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents themselves, with all their columns (a key's rows are drawn together)."""
    drawn = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["_drawn"]), "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's words."""
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: CRC-32 in SQL, over the bytes of a column named ``x``.
SQL_CRC = """
bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
SQL_CRC_OF = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode({x})) + 1), lambda i: CAST(concat('0x', substr(hex(encode({x})), 2 * i - 1, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH {SQL_CRC.strip()},
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, unnest(w) AS x FROM d), bw AS (SELECT unnest({_WORDS}) AS x FROM benchmark),
vocabulary AS (SELECT x, {SQL_CRC_OF.format(x="x")} % 10000 AS bucket FROM (SELECT x FROM dw UNION SELECT x FROM bw), bits),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN vocabulary USING (x) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN vocabulary USING (x) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (totals.t + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM (SELECT DISTINCT bucket FROM vocabulary) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals
),
weighed AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN vocabulary USING (x) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN weighed USING (r)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST) AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 10 * (SELECT count(*) FROM scored WHERE able) // 100 THEN k END AS rank FROM placed
"""
