"""Long-form TF-IDF: (doc, term, weight) tables and cosine scores against a query.

Terms are word 1- to n-grams over lower-cased word characters of length two
and more, stop words removed first; idf is ln((1 + N) / (1 + df)) + 1 and rows
are scaled to length one.  With a cap on features the terms of greatest total
count stay, ties by term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams
from ..storage import Store, tasks_for

# Own list of function words; a parameter everywhere.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be been before being below between both but by can could did do does "
    "down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my "
    "no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these "
    "they this those through to too under until up very was we were what when where which while who whom why will with would you your".split()
)
#: Runs are taken whole from left to right, so their ends need no test.
TOKEN = r"(?U)\w\w+"
#: Key of the query among the documents.
QUERY = "\0query"


@dataclass(frozen=True)
class Vectorizer:
    """Settings of the term weighting."""

    ngrams: int = 2
    max_features: int | None = 20_000
    stop_words: tuple[str, ...] = STOP_WORDS
    sublinear: bool = False
    max_df: float = 1.0


def terms_of(text: Column, v: Vectorizer) -> Column:
    """All n-grams of a text, with repeats."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)), lambda w: ~w.isin(*v.stop_words))
    if v.ngrams == 1:
        return words
    # The words are bound to a variable, as each mention of an expression is computed anew.
    return F.transform(F.array(words), lambda w: F.concat(w, bigrams(w)))[0]


def text_parts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """The number of documents, and of parts in which their texts are taken apart."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return n, tasks_for(docs.sparkSession, size)


def term_counts(docs: DataFrame, v: Vectorizer, parts: int, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, term, tf).

    Texts are dealt by document before they are taken apart, so that the counts
    need no shuffle of their own: a text is smaller than its terms.  A task
    holds the terms of one of ``parts`` parts, whose number follows the texts' size.
    """
    dealt = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartition(parts, "doc")
    return dealt.select("doc", F.explode(terms_of(F.col("text"), v)).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))


def features(counts: DataFrame, n_docs: int, v: Vectorizer, store: Store) -> DataFrame:
    """(term, idf) of the terms that count; a broadcast hint only where their number is bounded."""
    stats = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")).filter(F.col("df") <= v.max_df * n_docs)
    if v.max_features:
        stats = stats.orderBy(F.col("total").desc(), "term").limit(v.max_features)
    stats = store.put(stats.select("term", (F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")), "features")
    return F.broadcast(stats) if v.max_features else stats  # at most max_features rows


def _frequency(v: Vectorizer) -> Column:
    return F.lit(1.0) + F.log("tf") if v.sublinear else F.col("tf").cast("double")


def weights(docs: DataFrame, v: Vectorizer) -> DataFrame:
    """(doc, term, w) of unit length of (doc, text), dealt by doc; the counts are written once."""
    n_docs, parts = text_parts(docs)
    store = Store(docs.sparkSession, "weights", parts)
    counts = store.put(term_counts(docs, v, parts), "counts")
    raw = counts.join(features(counts, n_docs, v, store), "term").select("doc", "term", (_frequency(v) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return raw.repartition(parts, "doc").select("doc", "term", (F.col("w") / norm).alias("w"))


def cosine_scores(docs: DataFrame, query_text: str, v: Vectorizer = Vectorizer(), doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, score): cosine of every document with the query; the query counts among the fitted documents.

    Texts, counts and features are written once.  All terms of a document add to its
    length, but only the query's to the product, so one pass over the counts
    with two small tables beside it gives both.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, "tfidf")
    mark = docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"))
    asked = spark.createDataFrame([(QUERY, query_text)], "doc string, text string")
    texts = store.put(mark.unionByName(asked), "texts")
    n_docs, store.parts = text_parts(texts)
    counts = store.put(term_counts(texts, v, store.parts), "counts")
    store.drop("texts")
    weighted = counts.join(features(counts, n_docs, v, store), "term").select("doc", "term", (_frequency(v) * F.col("idf")).alias("w"))
    own = weighted.filter(F.col("doc") == QUERY)
    length = own.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    # The query's terms are as many as its words, and it is a parameter.
    asks = F.broadcast(store.put(own.crossJoin(F.broadcast(length)).select("term", (F.col("w") / F.col("length")).alias("qw")), "query"))
    sums = weighted.filter(F.col("doc") != QUERY).join(asks, "term", "left").groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = sums.select(F.col("doc").alias("_doc"), (F.coalesce("dot", F.lit(0.0)) / F.sqrt("square")).alias("_dot"))
    out = docs.select(F.col(doc)).join(scored, F.col(doc).cast("string") == F.col("_doc"), "left")
    return out.select(F.col(doc), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_dot", F.lit(0.0)))).alias("score"))
