"""Projections of the record model onto the synthetic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_line

#: Search texts of the projected pool; a document matches those whose words it has.
QUERIES = ("the of", "and in", "de la", "que el", "der die")
TOPIC = "the nation of information"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _collapse(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def papers_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the title, the rest the abstract."""
    docs = table(spark, sf_dir, "documents")
    line = first_line(F.col("text"))
    rest = F.substring(F.col("text"), F.length(line) + 2, F.length("text"))
    low = F.concat(F.lit(" "), _collapse(F.lower("text")), F.lit(" "))
    hit = lambda t, q: F.when(F.array_join(F.array(*(F.contains(t, F.lit(f" {w} ")).cast("int") for w in q.split())), "").rlike("^1+$"), F.lit(q))
    matched = F.transform(F.array(low), lambda t: F.array_compact(F.array(*(hit(t, q) for q in QUERIES))))[0]
    return docs.select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("paper_id"), _collapse(line).alias("title"), _collapse(rest).alias("abstract"),
        (2000 + F.col("doc_id") % 25).cast("int").alias("year"), (F.col("doc_id") * 7919 % 500).alias("citation_count"), "source", "lang",
        F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("pdf_url"), F.lit("").alias("venue"), F.lit("").alias("url"),
        F.array(F.concat(F.lit("Author"), (F.col("doc_id") % 7).cast("string"), F.lit(" Name"), (F.col("doc_id") % 11).cast("string"))).alias("authors"),
        matched.alias("matched_queries"),
    )


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) among nations: customers' nation to suppliers' nation, the three greatest flows of each, no loops."""
    from pyspark.sql import Window

    flow = (
        table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
        .join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src")), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst")), F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("src <> dst").groupBy("src", "dst").agg(F.sum("v").alias("w"))
    )
    best = Window.partitionBy("src").orderBy(F.round("w", 2).desc(), "dst")
    return flow.withColumn("rn", F.row_number().over(best)).filter("rn <= 3").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


def flow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node) of all nations."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))


def order_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper, ref): orders as records, their distinct parts as references."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("ref")).distinct()
