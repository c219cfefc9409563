"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's text is lower-cased and every run of other than letters becomes
one space, so n-grams also see word starts and ends.  The n-grams are hashed
into ``1 << BITS`` buckets; a feature is the square root of a bucket's share of
the document's n-grams.  Each feature is scaled by the log ratio of its
smoothed totals in the two classes (ratios within ``SIGNIFICANCE`` standard
errors count as none), and an L2-regularised logistic regression is fitted on
the scaled features.

The fit reads, of each class, the labelled rows whose key hashes lowest: at
most ``FIT_ROWS_PER_CLASS`` of them, and whole texts of at most
``FIT_BYTES_PER_CLASS`` bytes together, which bounds what reaches the driver;
class sizes for the prior come from all learnable labels.  Scoring covers every
row and text.

A null text counts as empty and scores as the prior says; a null label or key
is not learned from, and a row without a key is scored like others; very long
texts count whole; repeated rows score alike; with no labels of one class every
score is that of the other class's prior; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import bounded_slices, texts_of
from .tables import read_table
from .textops import gram_buckets

BITS = 18
GRAMS = (4, 5, 6)
FIT_ROWS_PER_CLASS = 1500
FIT_BYTES_PER_CLASS = 16 << 20
SMOOTHING = 1.0
PENALTY = 1e-5
#: A ratio counts where it exceeds this many standard errors; the rest of the shrinking is left to the penalty.
SIGNIFICANCE = 1.0
#: Added to a document's n-gram count, so that very short texts claim little.
OFFSET = 50
STEPS = 100
FOLDS, HELD_OUT = 5, 0
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(key: Column, folds: int = FOLDS, fold: int = HELD_OUT) -> Column:
    """Whether a row is kept from learning: crc32 of its key as text, by remainder."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def grams_of(text: str) -> np.ndarray:
    """Buckets of the text's n-grams, with repeats."""
    return gram_buckets(f" {_NOT_LETTERS.sub(' ', text.lower())} ", GRAMS, BITS)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """Feature values of bucket counts in a document of ``total`` n-grams."""
    return 10.0 * np.sqrt(counts / (total + OFFSET))


@dataclass
class NgramModel:
    """Weight per bucket (ratio times coefficient) and intercept."""

    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str]) -> np.ndarray:
        out, used = np.full(len(texts), self.intercept), self.weights != 0
        for i, t in enumerate(texts):
            grams = grams_of(t)
            found, counts = np.unique(grams[used[grams]], return_counts=True)
            out[i] += (self.weights[found] * shares(counts, len(grams))).sum()
        return 1.0 / (1.0 + np.exp(-np.clip(out, -40, 40)))


def packed(grams: np.ndarray) -> bytes:
    """Distinct buckets, counts and total in a few bytes per bucket (at most eight for each of the fixed number of buckets)."""
    found, counts = np.unique(grams, return_counts=True)
    return zlib.compress(np.concatenate([[len(grams)], np.diff(found, prepend=0), counts]).astype("<u4").tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, counts, total) of :func:`packed`."""
    flat = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
    half = (len(flat) - 1) // 2
    return np.cumsum(flat[1 : half + 1]), flat[half + 1 :], int(flat[0])


def fit_model(documents: list[bytes], labels: np.ndarray, class_sizes: tuple[int, int]) -> NgramModel:
    """Fit on packed documents; ``class_sizes`` counts all learnable rows of class 0 and 1."""
    prior = float(np.log((class_sizes[1] + 0.5) / (class_sizes[0] + 0.5)))
    flat = NgramModel(np.zeros(1 << BITS), prior)
    if not len(labels) or labels.min() == labels.max():
        return flat
    positive = labels > 0
    # Two passes, so that only n-grams that count are held at once.
    totals = [np.full(1 << BITS, SMOOTHING), np.full(1 << BITS, SMOOTHING)]
    for raw, y in zip(documents, positive, strict=True):
        found, counts, total = unpacked(raw)
        totals[0 if y else 1][found] += shares(counts, total)
    ratio = np.log(totals[0] / totals[0].sum()) - np.log(totals[1] / totals[1].sum())
    used = np.nonzero(np.abs(ratio) >= SIGNIFICANCE * np.sqrt(1 / totals[0] + 1 / totals[1]))[0]
    if not len(used):
        return flat
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    columns, values, sizes = [], [], []
    for raw in documents:
        found, counts, total = unpacked(raw)
        kept = place[found] >= 0
        columns.append(place[found[kept]])
        values.append(shares(counts[kept], total) * ratio[found[kept]])
        sizes.append(len(columns[-1]))
    column, value, owner = np.concatenate(columns), np.concatenate(values), np.repeat(np.arange(len(documents)), sizes)
    scale = 1.0 / np.sqrt(max(1e-12, (value * value).sum() / len(documents)))
    value = value * scale
    y = positive.astype(np.float64)
    w, b = np.zeros(len(used)), 0.0

    # L-BFGS: two loops over the last ten steps, backtracking line search.
    def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = np.bincount(owner, weights=value * w[column], minlength=len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        r = (p - y) / len(y)
        return float(np.logaddexp(0, np.where(y > 0, -z, z)).mean() + PENALTY * (w @ w) / 2), np.bincount(column, weights=value * r[owner], minlength=len(w)) + PENALTY * w, float(r.sum())

    value_now, grad, grad_b = loss(w, b)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        g = np.append(grad, grad_b)
        d, alphas = g.copy(), []
        for s, t in reversed(past):
            a = (s @ d) / (s @ t)
            alphas.append(a)
            d -= a * t
        if past:
            d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, t), a in zip(past, reversed(alphas), strict=True):
            d += s * (a - (t @ d) / (s @ t))
        step, slope = 1.0, g @ d
        while True:
            w2, b2 = w - step * d[:-1], b - step * d[-1]
            value2, grad2, grad_b2 = loss(w2, b2)
            if value2 <= value_now - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, t = np.append(w2 - w, b2 - b), np.append(grad2, grad_b2) - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t)]
        done = value_now - value2 < 1e-7
        w, b, value_now, grad, grad_b = w2, b2, value2, grad2, grad_b2
        if done:
            break
    weights = np.zeros(1 << BITS)
    weights[used] = w * ratio[used] * scale
    sampled = np.log(y.sum() / (len(y) - y.sum()))
    return NgramModel(weights, float(b + prior - sampled))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> NgramModel:
    """Learn ``label`` from the learnable rows of ``labels`` (doc_id, label) and their texts in ``docs``."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("y")]
    picked = usable.filter("y = 1").orderBy(*order).limit(FIT_ROWS_PER_CLASS).unionByName(usable.filter("y = 0").orderBy(*order).limit(FIT_ROWS_PER_CLASS))

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most two times FIT_ROWS_PER_CLASS rows, of numbers here and of n-grams below.
    lengths = keyed.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).join(F.broadcast(picked), "doc_id").select("doc_id", "y", "size", F.xxhash64("doc_id").alias("h")).collect()
    chosen, used = set(), {0: 0, 1: 0}
    for r in sorted(lengths, key=lambda r: (r.h, r.doc_id, r.y, r.size)):
        if used[r.y] + r.size <= FIT_BYTES_PER_CLASS:
            used[r.y] += r.size
            chosen.add((r.doc_id, r.y))
    if not chosen:
        return fit_model([], np.zeros(0), (sizes.get(0, 0), sizes.get(1, 0)))
    taken = docs.sparkSession.createDataFrame(sorted(chosen), "doc_id long, y int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            found = [packed(grams_of(t)) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "grams"])

    rows = keyed.join(F.broadcast(taken), "doc_id").mapInArrow(run, "doc_id long, y int, grams binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.grams))
    return fit_model([bytes(r.grams) for r in rows], np.array([r.y for r in rows]), (sizes.get(0, 0), sizes.get(1, 0)))


def score(docs: DataFrame, model: NgramModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            s = shared.value.scores(texts_of(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), held_out(key).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: NgramModel, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below ``threshold``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            yield b.filter(pa.array(shared.value.scores(texts_of(b)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    return score(docs, train(docs, read_table(spark, sf_dir, "labels")))
