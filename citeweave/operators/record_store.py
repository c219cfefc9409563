"""The persistent pool: versioned Parquet with keyed upsert, lookup, hydration and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import store_key
from ..functions.text import blank
from ..schemas import PERSISTED
from ..storage import Store
from .tfidf import TOKEN, Vectorizer, term_counts, terms_of, text_parts

#: A term that holds more than one in this many of all counts is frequent, so there are never more frequent terms than this.
HOT_TERMS = 1 << 17
#: Terms of queries that are held beside each task; more are dealt.
MOST_ASKED = 1 << 19


def keyed(papers: DataFrame) -> DataFrame:
    """Papers with their store key; those without one go."""
    return papers.withColumn("key", store_key(F.col("doi"), F.col("paper_id"), F.col("title"))).filter(~blank(F.col("key")))


def upsert(old: DataFrame, new: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """Rows of ``old`` with those of ``new`` over them; of several new rows of a key the last by ``order`` wins."""
    columns = [c for c in old.columns if c != key]
    latest = new.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("r")).select(key, "r.*")
    return old.select(key, *columns).join(latest.select(key), key, "left_anti").unionByName(latest.select(key, *columns))


def hydrate(papers: DataFrame, store: DataFrame) -> DataFrame:
    """Papers with blank fields filled from their stored row; authors too where the stored list is longer."""
    have = store.select(F.col("key").alias("_key"), *(F.col(c).alias(f"_{c}") for c in ("citation_count", "abstract", "doi", "pdf_url", "venue", "year", "openalex_id", "referenced_works", "authors")))
    joined = papers.withColumn("_own", store_key(F.col("doi"), F.col("paper_id"), F.col("title"))).join(have, F.col("_own") == F.col("_key"), "left")
    for c in ("abstract", "doi", "pdf_url", "venue", "openalex_id"):
        joined = joined.withColumn(c, F.when(blank(F.col(c)), F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    for c in ("citation_count", "year"):
        joined = joined.withColumn(c, F.when(F.coalesce(c, F.lit(0)) == 0, F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    joined = joined.withColumn("referenced_works", F.when(size("referenced_works") == 0, F.coalesce("_referenced_works", "referenced_works")).otherwise(F.col("referenced_works")))
    joined = joined.withColumn("authors", F.when(size("_authors") > size("authors"), F.col("_authors")).otherwise(F.col("authors")))
    return joined.select(*papers.columns)


def recall(docs: DataFrame, queries: DataFrame, top_k: int = 10, v: Vectorizer = Vectorizer(ngrams=1, max_features=None)) -> DataFrame:
    """(query, doc, score): for each query its best documents by TF-IDF cosine, each query fitted with the documents.

    A query adds one document to the corpus, and one to the document frequency
    of its own terms; both are put in by formula, so one pass over the corpus
    serves all queries.  Counts are written once.  Of them only those of the
    queries' terms are dealt, by document, so that products, lengths and the
    best of each part meet in one task.  Scores of zero are dropped after the cut.
    """
    n, parts = text_parts(docs)
    store = Store(docs.sparkSession, "recall", parts)
    counts = store.put(term_counts(docs, v, parts), "counts")
    df = store.put(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    asked = queries.select("query", F.explode(terms_of(F.col("text"), v)).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    idf = lambda d: F.log(F.lit(2.0 + n) / (1.0 + d)) + 1.0
    # Norms as if no term were shared with the query; the shared ones are corrected per pair.
    square = F.pow(F.col("tf") * idf(F.col("df")), 2)
    hot = F.col("df") * HOT_TERMS > (df.agg(F.sum("df")).first()[0] or 0)
    frequent, rare = df.filter(hot), df.filter(~hot)
    known = counts.join(F.broadcast(frequent), "term").select("doc", square.alias("s"))
    dealt = counts.join(F.broadcast(frequent.select("term")), "term", "left_anti").join(rare, "term").select("doc", square.alias("s"))
    norms = store.put(known.unionByName(dealt).groupBy("doc").agg(F.sum("s").alias("plain")), "norms")
    q = store.put(asked.join(df, "term", "left").select("query", "term", "qtf", "df", idf(F.coalesce("df", F.lit(0)) + 1.0).alias("up")), "asked")
    q_norm = q.groupBy("query").agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("up"), 2))).alias("qn"))
    few = q.count() <= MOST_ASKED
    beside = (lambda table: F.broadcast(table)) if few else (lambda table: table)
    shared = counts.join(beside(q.select("term").distinct()), "term", "left_semi").repartition(parts, "doc").join(beside(q), "term")
    up, own = F.col("tf") * F.col("up"), F.col("tf") * idf(F.col("df"))
    pair = shared.groupBy("query", "doc").agg(F.sum(up * F.col("qtf") * F.col("up")).alias("dot"), F.sum(F.pow(up, 2) - F.pow(own, 2)).alias("shift"))
    scored = pair.join(norms.repartition(parts, "doc"), "doc").join(beside(q_norm), "query").select("query", "doc", (F.col("dot") / (F.col("qn") * F.sqrt(F.col("plain") + F.col("shift")))).alias("score"))
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc")
    ranked = scored.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= top_k).filter("score > 0").drop("rn")
    return store.put(ranked, "best")


class RecordStore:
    """Versions of the pool below a folder: each write adds one, readers take the newest complete one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        names = [s.getPath() for s in fs.listStatus(base)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The newest version, or None."""
        found = self._versions()
        return self.spark.read.parquet(f"{self.root}/v{found[-1]}") if found else None

    def write(self, papers: DataFrame) -> None:
        """Upsert papers by store key; of equal keys in the batch the last by position wins."""
        rows = keyed(papers).select("key", *PERSISTED, F.col("pos").alias("seq")).withColumn("updated_at", F.current_timestamp())
        old, found = self.read(), self._versions()
        fresh = old if old is not None else rows.drop("seq").limit(0)
        upsert(fresh, rows).write.parquet(f"{self.root}/v{found[-1] + 1 if found else 1}")

    def get(self, key: str) -> DataFrame | None:
        """The stored row of a key."""
        rows = self.read()
        return None if rows is None else rows.filter(F.col("key") == key)

    def recall(self, queries: list[str], top_k: int) -> DataFrame | None:
        """Stored records nearest to the queries, ``top_k`` of each, by query and score, each key once, numbered by ``pos``; None without a version."""
        rows = self.read()
        if rows is None:
            return None
        asked = self.spark.createDataFrame(list(enumerate(dict.fromkeys(queries))), "query int, text string")
        best = recall(rows.select(F.col("key").alias("doc"), F.concat_ws(" ", "title", "abstract").alias("text")), asked, top_k)
        # At most top_k rows a query from here on.
        first = best.groupBy("doc").agg(F.min(F.struct("query", -F.col("score"))).alias("at"))
        placed = first.select(F.col("doc").alias("key"), (F.row_number().over(Window.orderBy("at", "doc")) - 1).cast("long").alias("pos"))
        return rows.filter(~blank(F.col("paper_id"))).join(F.broadcast(placed), "key").select("pos", *PERSISTED)

    def reset(self) -> None:
        """Drop all versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


__all__ = ["TOKEN", "RecordStore", "hydrate", "keyed", "recall", "upsert"]
