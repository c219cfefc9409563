"""Topic clustering, keywords, stable citation numbers and matching across versions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tfidf import STOP_WORDS, Vectorizer, weights

# Fixed value: words too common in scientific text to name a topic.
TOPIC_STOP = (
    "paper", "propose", "proposed", "method", "methods", "approach", "approaches",
    "results", "result", "show", "shows", "shown", "based", "using", "used", "use",
    "novel", "new", "study", "studies", "work", "works", "model", "models",
    "state", "art", "performance", "task", "tasks", "data", "dataset", "datasets",
    "experiments", "experimental", "achieve", "achieves", "compared", "existing",
)
TOPIC_TERMS = Vectorizer(ngrams=2, max_features=8000, stop_words=(*STOP_WORDS, *TOPIC_STOP), sublinear=True, max_df=0.85)
SEED, RESTARTS, KEYWORDS = 42, 10, 8
#: Rows of a block of the silhouette, and rows of it that are held against another block at once.
BLOCK_ROWS, STRIP_ROWS = 4096, 256


def choose_k(n: int, requested: int = 0) -> int:
    """Clusters for n records: 1 up to two, a request within n - 1, else sqrt(n / 2) within 2 to 8 and n - 1."""
    if n <= 2:
        return 1
    if requested > 0:
        return max(1, min(requested, n - 1))
    return max(2, min(8, n - 1, round(math.sqrt(n / 2))))


def chosen_k(n: Column) -> Column:
    """:func:`choose_k` without a request, of a column of sizes."""
    return F.when(n <= 2, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(8), n - 1, F.bround(F.sqrt(n / 2), 0).cast("long"))))


def embed(docs: DataFrame, dims: int = 128, v: Vectorizer = TOPIC_TERMS) -> DataFrame:
    """(doc, v): unit vectors of (doc, text) by TF-IDF and truncated SVD."""
    n = docs.count()
    w = weights(docs, v)
    terms = w.select("term").distinct().withColumn("j", F.row_number().over(Window.orderBy("term")) - 1)
    width = terms.count()
    rows = w.join(F.broadcast(terms), "term").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("m"))
    indexed = rows.rdd.map(lambda r: IndexedRow(r.doc, OldVectors.sparse(width, r.m)))
    k = max(1, min(dims, width - 1, n - 1))
    u = IndexedRowMatrix(indexed).computeSVD(k, computeU=True)
    s = u.s.toArray()
    out = docs.sparkSession.createDataFrame(u.U.rows.map(lambda r: (r.index, DenseVector(r.vector.toArray() * s))), ["doc", "u"]).select("doc", vector_to_array("u").alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("doc", F.transform("u", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("v"))


def _features(vectors: DataFrame) -> DataFrame:
    return vectors.select("doc", "v", array_to_vector(F.col("v")).alias("features"))


def _fit(data: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED) -> KMeansModel:
    """The run of least cost among the restarts."""
    return min((KMeans(k=k, seed=seed + i, maxIter=100).fit(data) for i in range(restarts)), key=lambda m: m.summary.trainingCost)


def kmeans(vectors: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """(doc, cluster): the run of least cost among the restarts."""
    data = _features(vectors).drop("v").persist()
    try:
        best = _fit(data, k, restarts, seed)
    finally:
        data.unpersist()
    return best.transform(data).select("doc", F.col("prediction").alias("cluster"))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows; those near zero, where the product cancels, are taken from the differences."""
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[None, :]
    d = xx + yy - 2 * (x @ y.T)
    near, other = np.nonzero(d <= 1e-5 * (xx + yy))
    for lo in range(0, len(near), 1 << 14):
        i, j = near[lo : lo + (1 << 14)], other[lo : lo + (1 << 14)]
        d[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.sqrt(d)


def distance_sums(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Rows of (doc, v, a cluster column a labelling) with ``sums``: their distances to each cluster, added up.

    ``widths`` names the labelling columns and how many clusters (numbered from 0) each has; ``sums`` holds them one
    labelling after the other.  Records are dealt to blocks of about ``BLOCK_ROWS``; each pair of blocks is a cell that
    takes all distances between them from one matrix product a strip and gives one row a record, so a cell's memory is
    bounded, no pair of records is a row, and all labellings share the distances.  ``doc`` is a key of the rows.
    """
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    names, total = list(widths), sum(widths.values())
    block = F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int")
    cell = F.struct(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    dealt = rows.select("doc", "v", *names, block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", cell)

    def towards(x: np.ndarray, y: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return np.concatenate([_distances(x[lo : lo + STRIP_ROWS], y) @ marks for lo in range(0, len(x), STRIP_ROWS)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["block"] == n] for n in sorted(frame["block"].unique())]
        points = [np.stack(side["v"].to_numpy()).astype(float) for side in sides]
        marks = []
        for side in sides:
            columns = [side[name].to_numpy()[:, None] == np.arange(width)[None, :] for name, width in widths.items()]
            marks.append(np.concatenate(columns, axis=1).astype(float))
        out = []
        both = frame["cell"].iloc[0]
        if both["a"] == both["b"]:
            out.append((sides[0]["doc"], towards(points[0], points[0], marks[0])))
        elif len(sides) == 2:
            out += [(sides[0]["doc"], towards(points[0], points[1], marks[1])), (sides[1]["doc"], towards(points[1], points[0], marks[0]))]
        frames = [pd.DataFrame({"doc": doc.to_numpy(), **{f"s{n}": sums[:, n] for n in range(total)}}) for doc, sums in out]
        return pd.concat(frames) if frames else pd.DataFrame(columns=["doc", *(f"s{n}" for n in range(total))])

    schema = f"doc {rows.schema['doc'].dataType.simpleString()}, " + ", ".join(f"s{n} double" for n in range(total))
    added = dealt.groupBy("cell").applyInPandas(run, schema).groupBy("doc").agg(*(F.sum(f"s{n}").alias(f"s{n}") for n in range(total)))
    return rows.join(added.select("doc", F.array(*(f"s{n}" for n in range(total))).alias("sums")), "doc")


def silhouettes(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """(doc, one column a labelling): each record's Euclidean silhouette in each labelling.

    A record alone in its cluster has 0, and so has one whose distances are all 0 or that has no other cluster.
    """
    found, at, out = distance_sums(rows, widths), 0, []
    counts = rows.agg(*(F.count_if(F.col(name) == c).alias(f"{name}_{c}") for name, width in widths.items() for c in range(width))).first()
    for name, width in widths.items():
        sizes = [counts[f"{name}_{c}"] for c in range(width)]
        own = F.col(name)
        size = F.get(F.array(*map(F.lit, sizes)), own)
        a = F.get("sums", own + at) / F.nullif(size - 1, F.lit(0))
        b = F.least(*(F.when((own != c) & F.lit(sizes[c] > 0), F.get("sums", F.lit(at + c)) / max(1, sizes[c])) for c in range(width)), F.lit(None).cast("double"))
        out.append(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)) if width > 1 else F.lit(0.0))
        out[-1] = F.when(a.isNull() | b.isNull(), 0.0).otherwise(out[-1]).alias(name)
        at += width
    return found.select("doc", *out)


def silhouette(vectors: DataFrame, clusters: DataFrame) -> float:
    """Mean Euclidean silhouette of (doc, v) in (doc, cluster), clusters numbered from 0; singletons count zero."""
    rows = vectors.join(clusters, "doc")
    width = rows.agg(F.max("cluster")).first()[0]
    if width is None:
        return 0.0
    return silhouettes(rows, {"cluster": width + 1}).agg(F.avg("cluster")).first()[0]


def best_k(vectors: DataFrame, cap: int) -> int:
    """The number of clusters of greatest mean silhouette from 2 to ``cap``, the smallest on ties, at any size.

    All candidates are fitted first and measured in one pass over the distances.
    """
    data = _features(vectors).persist()
    try:
        rows, widths = data, {}
        for k in range(2, cap + 1):
            rows = _fit(data, k).setPredictionCol(f"k{k}").transform(rows)
            widths[f"k{k}"] = k
        if not widths:
            return 2
        scores = silhouettes(rows.drop("features"), widths).agg(*(F.avg(name).alias(name) for name in widths)).first()
    finally:
        data.unpersist()
    found, top = 2, -2.0
    for name, k in widths.items():
        if scores[name] is not None and scores[name] > top + 1e-9:
            found, top = k, scores[name]
    return found


def renumber(clusters: DataFrame) -> DataFrame:
    """(doc, cluster_id): clusters by size, 0 the largest, ties by old number."""
    sizes = clusters.groupBy("cluster").count()
    # One row per cluster.
    order = sizes.withColumn("cluster_id", F.row_number().over(Window.orderBy(F.col("count").desc(), "cluster")) - 1)
    return clusters.join(F.broadcast(order), "cluster").select("doc", "cluster_id")


def cluster_papers(papers: DataFrame, requested: int = 0, auto_tune: bool = True) -> DataFrame:
    """(pos, cluster_id) of all records; up to three records are one cluster."""
    n = papers.count()
    if n <= 3:
        return papers.select("pos", F.lit(0).alias("cluster_id"))
    text = F.concat_ws(". ", "title", "title", "abstract")
    vectors = embed(papers.select(F.col("pos").alias("doc"), text.alias("text"))).cache()
    k = choose_k(n, requested)
    if auto_tune and not requested:
        k = best_k(vectors, k)
    found = kmeans(vectors, k)
    placed = papers.select(F.col("pos").alias("doc")).join(found, "doc", "left").fillna({"cluster": 0})
    return renumber(placed).withColumnRenamed("doc", "pos")


def keywords(docs: DataFrame, top: int = KEYWORDS, v: Vectorizer = TOPIC_TERMS) -> DataFrame:
    """(cluster, rn, term, mean) of (doc, cluster, text): best terms by mean weight, absent terms counting zero."""
    w = weights(docs.select("doc", "text"), v)
    sizes = docs.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    mean = w.join(docs.select("doc", "cluster"), "doc").groupBy("cluster", "term").agg(F.sum("w").alias("sum")).join(F.broadcast(sizes), "cluster").select("cluster", "term", (F.col("sum") / F.col("size")).alias("mean"))
    order = Window.partitionBy("cluster").orderBy(F.round("mean", 9).desc(), "term")
    return mean.filter("mean > 0").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)


def number_citations(members: DataFrame, existing: DataFrame) -> DataFrame:
    """(paper_id, n): existing numbers stay; new ids follow the greatest, by cluster, then score, then position.

    ``members`` has paper_id, cluster_id, score and pos.  Ranks are taken within
    clusters and shifted by the clusters before, so no one task sees all rows.
    """
    top = existing.agg(F.coalesce(F.max("n"), F.lit(0)).alias("top"))
    first = members.groupBy("paper_id").agg(F.min(F.struct("cluster_id", (-F.col("score")).alias("s"), "pos")).alias("r")).select("paper_id", "r.*")
    fresh = first.join(existing.select("paper_id"), "paper_id", "left_anti")
    within = fresh.withColumn("i", F.row_number().over(Window.partitionBy("cluster_id").orderBy("s", "pos", "paper_id")))
    sizes = fresh.groupBy("cluster_id").count().withColumn("before", F.sum("count").over(Window.orderBy("cluster_id")) - F.col("count"))
    new = within.join(F.broadcast(sizes), "cluster_id").crossJoin(F.broadcast(top)).select("paper_id", (F.col("top") + F.col("before") + F.col("i")).alias("n"))
    return existing.select("paper_id", F.col("n").cast("long").alias("n")).unionByName(new)


def match_versions(current: DataFrame, previous: DataFrame, written: DataFrame, keep: float = 0.5) -> DataFrame:
    """(cluster, prev, ratio, kept): per current cluster the previous one that covers most of it.

    Inputs are (cluster, paper_id); ties go to the lesser previous cluster; a
    section is kept if the overlap reaches ``keep`` and the previous cluster's
    text is in ``written`` (cluster).
    """
    size = current.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    both = current.join(previous.select(F.col("cluster").alias("prev"), "paper_id"), "paper_id").groupBy("cluster", "prev").agg(F.count(F.lit(1)).alias("common"))
    ratio = both.join(size, "cluster").withColumn("ratio", F.col("common") / F.col("size"))
    best = ratio.groupBy("cluster").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "prev", "ratio")).alias("b"))
    text = written.select(F.col("cluster").alias("prev")).distinct().withColumn("has", F.lit(True))
    out = size.join(best.select("cluster", "b.prev", "b.ratio"), "cluster", "left").join(text, "prev", "left")
    return out.select("cluster", "prev", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), ((F.coalesce("ratio", F.lit(0.0)) >= keep) & F.coalesce("has", F.lit(False))).alias("kept"))


def best_cluster(text_words: list[str], clusters: DataFrame) -> DataFrame:
    """The cluster whose label and keywords share most words with a feedback text; the first on ties, none without overlap."""
    words = F.array(*(F.lit(w) for w in text_words)) if text_words else F.array().cast("array<string>")
    own = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "label", F.array_join("keywords", " "))), r"\W+"))
    return clusters.withColumn("overlap", F.size(F.array_intersect(words, own))).filter("overlap > 0").orderBy(F.col("overlap").desc(), "cluster_id").limit(1)
