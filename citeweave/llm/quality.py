"""Quality: a regularised quadratic discriminant over transformed document statistics.

Every document is described by statistics of its characters, words and lines,
transformed to be roughly normal.  Each class has a Gaussian whose covariance
is shrunk towards the pooled covariance and towards its own scaled identity;
the score compares the two log densities, computed as Mahalanobis distances
with cached Cholesky factors, and the class priors.

The fit uses every learnable label: counts, sums and cross products are added
up in the executors, and only those few numbers reach the driver.

A null text counts as empty; a null label is not learned from; repeated rows
score alike; with fewer than two learned rows of a class the score is the
prior; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_tools import bounded_slices, utf8_of
from ..storage import Store
from .tables import read_table
from .textops import words_of
from .toxicity import held_out

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
POOLED = 0.2
SPHERICAL = 0.02
#: Log density differences are divided by this, as neighbouring statistics are not independent.
TEMPERATURE = 4.0

_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LOWER[97:123] = True
_DIGIT[48:58] = True
_SYMBOL[[c for c in range(33, 127) if not (chr(c).isalnum() or chr(c) in ".,;:'\"-()")]] = True
STATISTICS = (
    "log words", "log bytes", "mean word length", "spread of word length", "upper share", "digit share", "symbol share", "non-ASCII share",
    "plain words", "words ending in a symbol", "capitalised words", "short words", "distinct words", "commonest word", "repeated pairs", "distinct lines",
    "words a line", "sentence ends",
)


def _logit(share: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of a share, smoothed by what a sample of n can tell."""
    return np.log((share * n + 0.5) / ((1 - share) * n + 0.5))


def statistics(texts: list[bytes]) -> np.ndarray:
    """Documents x STATISTICS."""
    count = len(texts)
    w = words_of(texts)
    sizes = np.diff(w.doc_start).astype(float)
    n = np.bincount(w.doc, minlength=count).astype(float)
    safe, safe_bytes = np.maximum(n, 1), np.maximum(sizes, 1)
    per_doc = lambda weights: np.bincount(w.doc, weights=weights, minlength=count)

    def byte_total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask[w.raw], dtype=np.int64)])
        return (sums[w.doc_start[1:]] - sums[w.doc_start[:-1]]).astype(float)

    length = (w.end - w.start).astype(float)
    mean = per_doc(length) / safe
    spread = np.sqrt(np.maximum(per_doc(length * length) / safe - mean * mean, 0))
    high = np.arange(256) >= 128
    first, last = (w.raw[w.start], w.raw[w.end - 1]) if len(w.start) else (w.raw, w.raw)
    plain = _LOWER[last] | high[last] | np.isin(last, [44, 46])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.nonzero(fresh)[0]
    runs = np.diff(np.append(at, len(h)))
    commonest = np.zeros(count)
    np.maximum.at(commonest, d[at], runs.astype(float))
    pair = w.hash[:-1] * np.uint64(0x9E3779B97F4A7C15) + w.hash[1:] if len(w.hash) else w.hash
    same = w.doc[:-1] == w.doc[1:]
    pair, owner = pair[same], w.doc[:-1][same]
    order = np.lexsort((pair, owner))
    pair, owner = pair[order], owner[order]
    again = np.bincount(owner[1:][(pair[1:] == pair[:-1]) & (owner[1:] == owner[:-1])], minlength=count) if len(pair) else np.zeros(count)
    breaks = np.zeros(256, bool)
    breaks[10] = True
    lines = byte_total(breaks) + 1
    line_of = np.cumsum(breaks[w.raw], dtype=np.int64)[w.start] if len(w.start) else w.start
    # A line's content is the sum of its word hashes, weighted by place.
    key = w.doc * (int(line_of.max(initial=0)) + 1) + line_of
    starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    place = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key)))) if len(key) else key
    content = np.add.reduceat(w.hash * (2 * place + 1).astype(np.uint64), starts) if len(starts) else w.hash
    line_doc = w.doc[starts] if len(starts) else w.doc
    order = np.lexsort((content, line_doc))
    content, line_doc = content[order], line_doc[order]
    new = np.ones(len(content), bool)
    new[1:] = (content[1:] != content[:-1]) | (line_doc[1:] != line_doc[:-1])
    full_lines = np.maximum(np.bincount(line_doc, minlength=count), 1)
    ends = per_doc((last == 46).astype(float))
    columns = [
        np.log1p(n), np.log1p(sizes), np.log1p(mean), np.log1p(spread),
        _logit(byte_total(_UPPER) / safe_bytes, sizes), _logit(byte_total(_DIGIT) / safe_bytes, sizes), _logit(byte_total(_SYMBOL) / safe_bytes, sizes), _logit(byte_total(high) / safe_bytes, sizes),
        _logit(per_doc(plain.astype(float)) / safe, n), _logit(per_doc(_SYMBOL[last].astype(float)) / safe, n), _logit(per_doc(_UPPER[first].astype(float)) / safe, n), _logit(per_doc((length <= 3).astype(float)) / safe, n),
        _logit(np.bincount(d[at], minlength=count) / safe, n), _logit(commonest / safe, n), _logit(again / safe, n), _logit(np.bincount(line_doc[new], minlength=count) / full_lines, full_lines.astype(float)),
        np.log1p(n / lines), _logit(np.minimum(ends / safe, 1), n),
    ]
    return np.stack(columns, 1)


@dataclass
class Discriminant:
    """Means and Cholesky factors per class, and the prior's log odds."""

    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    half_log_det: list[float] = field(default_factory=list)
    prior: float = 0.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        if self.factors and len(x):
            density = []
            for mean, factor, half in zip(self.means, self.factors, self.half_log_det, strict=True):
                y = np.linalg.solve(factor, (x - mean).T)
                density.append(-0.5 * (y * y).sum(0) - half)
            z = z + (density[1] - density[0]) / TEMPERATURE
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """From per-class (count, sum, sum of outer products)."""
    n = [moments[c][0] if c in moments else 0.0 for c in (0, 1)]
    model = Discriminant(prior=float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    if min(n) < 2:
        return model
    means = [moments[c][1] / n[c] for c in (0, 1)]
    scatter = [moments[c][2] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / sum(n)
    unit = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    for c in (0, 1):
        cov = (1 - POOLED) * scatter[c] / n[c] + POOLED * pooled
        # Shrink on the scale of the pooled spreads, so that no statistic's unit matters.
        scaled = cov / np.outer(unit, unit)
        scaled = (1 - SPHERICAL) * scaled + SPHERICAL * np.eye(len(unit)) * max(np.trace(scaled) / len(unit), 1e-6)
        factor = np.linalg.cholesky(scaled * np.outer(unit, unit))
        model.means.append(means[c])
        model.factors.append(factor)
        model.half_log_det.append(float(np.log(np.diag(factor)).sum()))
    return model


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): each document's statistics."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded_slices(batches, "text"):
            x = statistics(utf8_of(b))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), flat], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant:
    """Fit on the statistics of all learnable labelled rows."""
    key = F.col("doc_id").cast("long")
    usable = labels.select(key.alias("doc_id"), (F.col(label) > 0).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_OUT))
    size = len(STATISTICS)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(-1, size)
            y = b.column("y").to_numpy()
            for c in (0, 1):
                own = x[y == c]
                a, s, o = sums.get(c, (0.0, 0.0, 0.0))
                sums[c] = (a + len(own), s + own.sum(0), o + own.T @ own)
        for c, (a, s, o) in sums.items():
            flat = np.concatenate([[a], s, o.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(flat), pa.int32()), pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["c", "i", "v"])

    partial = stats.join(usable, "doc_id").select("y", "x").mapInArrow(moments, "c int, i int, v double")
    found: dict[int, np.ndarray] = {}
    for r in partial.groupBy("c", "i").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.c, np.zeros(1 + size + size * size))[r.i] = r.v
    return fit_discriminant({c: (v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size)) for c, v in found.items()})


def score(stats: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document's statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)  # two matrices of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            s = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "x").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    stats = Store(spark, "quality").put(document_statistics(read_table(spark, sf_dir, "documents")), "statistics")
    return score(stats, train(stats, read_table(spark, sf_dir, "labels")))
