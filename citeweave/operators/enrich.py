"""Lookups that complete records: citation counts, full-text places, stored fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import title_fingerprint
from ..functions.text import blank

# Parts of addresses behind a paywall.
PAYWALLED = ("sciencedirect.com", "springer.com/article", "onlinelibrary.wiley.com/doi/abs", "ieeexplore.ieee.org/document", "dl.acm.org/doi/abs")


def paywalled(url: Column) -> Column:
    """Whether an address is known to be behind a paywall."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.lit(False)
    for part in PAYWALLED:
        out = out | F.contains(low, F.lit(part))
    return out


def oa_available(pdf_url: Column, doi: Column) -> Column:
    """Whether a text might be had: an open address, or any DOI."""
    return (~blank(pdf_url) & ~paywalled(pdf_url)) | ~blank(doi)


def resolve_fulltext(papers: DataFrame, places: DataFrame) -> DataFrame:
    """Papers with ``text_url`` and ``licence``: their own open address, else the looked-up one (doi, pdf_url, licence)."""
    found = places.select(F.col("doi").alias("_doi"), F.col("pdf_url").alias("_url"), F.col("licence").alias("_licence"))
    joined = papers.join(found, papers.doi == found._doi, "left")
    own = ~blank(F.col("pdf_url")) & ~paywalled(F.col("pdf_url"))
    other = ~blank(F.col("_url")) & ~paywalled(F.col("_url"))
    url = F.when(own, F.col("pdf_url")).when(other, F.col("_url"))
    licence = F.when(own, F.lit("source-provided")).when(other, F.coalesce(F.when(~blank(F.col("_licence")), F.col("_licence")), F.lit("unpaywall")))
    return joined.withColumn("text_url", url).withColumn("licence", licence).drop("_doi", "_url", "_licence")


def enrich_citations(papers: DataFrame, lookup: DataFrame, limit: int = 25) -> DataFrame:
    """Fill citation counts of the first ``limit`` records without one: by DOI, else by the first 60 characters of the title fingerprint.

    ``lookup`` has doi, title and citation_count; its greatest count per key
    counts.  A title match also fills a blank DOI.
    """
    missing = papers.filter(F.coalesce("citation_count", F.lit(0)) == 0).orderBy("pos").limit(limit).select("pos")
    prefix = lambda c: F.substring(title_fingerprint(c), 1, 60)
    by_doi = lookup.filter(~blank(F.col("doi"))).groupBy(F.col("doi").alias("_doi")).agg(F.max("citation_count").alias("_by_doi"))
    by_title = lookup.withColumn("_fp", prefix(F.col("title"))).filter("_fp <> ''").groupBy("_fp").agg(F.max("citation_count").alias("_by_title"), F.max_by("doi", F.struct("citation_count", "doi")).alias("_title_doi"))
    marked = papers.join(F.broadcast(missing.withColumn("_wanted", F.lit(True))), "pos", "left").withColumn("_fp", prefix(F.col("title")))
    joined = marked.join(by_doi, marked.doi == by_doi._doi, "left").join(by_title, "_fp", "left")
    found = F.when(F.col("_wanted"), F.coalesce("_by_doi", "_by_title"))
    doi = F.when(F.col("_wanted") & blank(F.col("doi")), F.col("_title_doi")).otherwise(F.col("doi"))
    out = joined.withColumn("citation_count", F.coalesce(found, F.col("citation_count"))).withColumn("doi", doi)
    return out.select(*papers.columns)
