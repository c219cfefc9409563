"""Raw source payloads (JSON, XML) to records of the fixed schema, as DataFrame projections.

Each parser takes a DataFrame with ``payload`` (one work or entry per row),
``query`` and ``pos`` and returns the record columns; a payload that does not
parse, JSON or XML, gives a record without a title, which deduplication drops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import last_segment, normalize_doi, rebuild_abstract, title_fingerprint, unversioned_id
from ..functions.text import blank, clean_text, filled, strip_markup
from .xml_fields import atom_fields, medline_fields

MOST_AUTHORS = 20

OPENALEX = (
    "id string, doi string, display_name string, title string, publication_year int, cited_by_count bigint, "
    "abstract_inverted_index map<string,array<int>>, open_access struct<oa_url:string>, best_oa_location struct<pdf_url:string>, "
    "primary_location struct<landing_page_url:string,source:struct<display_name:string>>, "
    "authorships array<struct<author:struct<display_name:string>>>, referenced_works array<string>"
)
SEMANTIC_SCHOLAR = (
    "paperId string, title string, abstract string, year int, venue string, citationCount bigint, url string, "
    "externalIds struct<DOI:string,ArXiv:string>, openAccessPdf struct<url:string>, authors array<struct<name:string>>"
)
CROSSREF = (
    "DOI string, title array<string>, abstract string, URL string, `is-referenced-by-count` bigint, `container-title` array<string>, "
    "author array<struct<given:string,family:string,name:string>>, issued struct<`date-parts`:array<array<int>>>, "
    "`published-print` struct<`date-parts`:array<array<int>>>, published struct<`date-parts`:array<array<int>>>, created struct<`date-parts`:array<array<int>>>"
)
_STRINGS = "array<string>"


def make_paper(df: DataFrame, **fields: Column) -> DataFrame:
    """The record projection: cleaned text, defaults for what is absent, a valid DOI or null."""
    get = lambda name, default: F.coalesce(fields.get(name, F.lit(None)), default)
    empty, none = F.array().cast(_STRINGS), F.lit(None).cast("string")
    return df.select(
        F.col("pos"), get("paper_id", F.lit("")).alias("paper_id"), clean_text(get("title", F.lit(""))).alias("title"), get("authors", empty).alias("authors"),
        fields.get("year", F.lit(None)).cast("int").alias("year"), clean_text(get("venue", F.lit(""))).alias("venue"), get("citation_count", F.lit(0)).cast("long").alias("citation_count"),
        clean_text(get("abstract", F.lit(""))).alias("abstract"), get("url", F.lit("")).alias("url"), fields.get("pdf_url", none).alias("pdf_url"), normalize_doi(fields.get("doi", none)).alias("doi"),
        fields["source"].alias("source"), F.array("query").alias("matched_queries"), get("openalex_id", F.lit("")).alias("openalex_id"), get("referenced_works", empty).alias("referenced_works"),
    )


def parse_openalex(df: DataFrame) -> DataFrame:
    """Works as JSON; ids are DOIs, else the index's own."""
    w = F.col("w")
    df = df.withColumn("w", F.from_json("payload", OPENALEX))
    doi, own = normalize_doi(w["doi"]), last_segment(F.coalesce(w["id"], F.lit("")))
    names = F.filter(F.transform(F.slice(F.coalesce(w["authorships"], F.array()), 1, MOST_AUTHORS), lambda a: clean_text(a["author"]["display_name"])), lambda n: n != "")
    return make_paper(
        df, paper_id=F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("openalex:"), own)), title=F.coalesce(filled(w["display_name"]), w["title"]), authors=names, year=w["publication_year"],
        venue=w["primary_location"]["source"]["display_name"], citation_count=w["cited_by_count"], abstract=rebuild_abstract(w["abstract_inverted_index"]),
        url=F.coalesce(filled(w["primary_location"]["landing_page_url"]), F.concat(F.lit("https://doi.org/"), doi), w["id"]), pdf_url=F.coalesce(filled(w["best_oa_location"]["pdf_url"]), w["open_access"]["oa_url"]),
        doi=doi, source=F.lit("openalex"), openalex_id=own, referenced_works=w["referenced_works"],
    )


def parse_semantic_scholar(df: DataFrame) -> DataFrame:
    """Papers as JSON; ids are DOIs, else preprint ids, else the index's own; empty author names stay."""
    w = F.col("w")
    df = df.withColumn("w", F.from_json("payload", SEMANTIC_SCHOLAR))
    doi, aid = normalize_doi(w["externalIds"]["DOI"]), filled(unversioned_id(w["externalIds"]["ArXiv"]))
    paper_id = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), aid), F.concat(F.lit("s2:"), w["paperId"]))
    return make_paper(
        df, paper_id=paper_id, title=w["title"], authors=F.transform(F.slice(F.coalesce(w["authors"], F.array()), 1, MOST_AUTHORS), lambda a: clean_text(a["name"])), year=w["year"], venue=w["venue"],
        citation_count=w["citationCount"], abstract=w["abstract"], url=w["url"], pdf_url=F.coalesce(filled(w["openAccessPdf"]["url"]), F.concat(F.lit("https://arxiv.org/pdf/"), aid)), doi=doi, source=F.lit("semantic_scholar"),
    )


def parse_crossref(df: DataFrame) -> DataFrame:
    """Items as JSON; the year is the first dated of issued, print, published and created."""
    w = F.col("w")
    df = df.withColumn("w", F.from_json("payload", CROSSREF))
    year = F.coalesce(*(F.try_element_at(F.try_element_at(w[d]["date-parts"], F.lit(1)), F.lit(1)) for d in ("issued", "published-print", "published", "created")))
    name = lambda a: clean_text(F.coalesce(filled(F.concat_ws(" ", a["given"], a["family"])), a["name"]))
    doi, title = normalize_doi(w["DOI"]), clean_text(F.try_element_at(w["title"], F.lit(1)))
    return make_paper(
        df, paper_id=F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("crossref:"), F.substring(title, 1, 40))), title=title,
        authors=F.filter(F.transform(F.coalesce(w["author"], F.array()), name), lambda n: n != ""), year=year, venue=F.try_element_at(w["container-title"], F.lit(1)),
        citation_count=w["is-referenced-by-count"], abstract=strip_markup(w["abstract"]), url=F.coalesce(filled(w["URL"]), F.concat(F.lit("https://doi.org/"), doi)), doi=doi, source=F.lit("crossref"),
    )


def parse_arxiv(df: DataFrame) -> DataFrame:
    """Atom entries; the year is that of publication, the PDF link is made up where it is not given."""
    w = F.col("w")
    df = df.withColumn("w", atom_fields("payload"))
    aid = F.when(w["sound"], unversioned_id(F.substring_index(w["id"], "/abs/", -1)))
    published = F.substring(F.trim(w["published"]), 1, 4)
    return make_paper(
        df, paper_id=F.concat(F.lit("arxiv:"), aid), title=w["title"], authors=F.filter(F.transform(w["authors"], clean_text), lambda n: n != ""), year=F.when(published.rlike(r"^\d{4}$"), published.try_cast("int")),
        venue=F.when(w["sound"], F.coalesce(filled(clean_text(w["journal"])), F.lit("arXiv preprint"))), abstract=w["summary"], url=F.concat(F.lit("https://arxiv.org/abs/"), aid),
        pdf_url=F.coalesce(filled(w["pdf"]), F.concat(F.lit("https://arxiv.org/pdf/"), aid)), doi=w["doi"], source=F.lit("arxiv"),
    )


def parse_pubmed(df: DataFrame, open_access: DataFrame | None = None) -> DataFrame:
    """Medline articles, left-joined with a table (pmid, pdf_url) of open texts; DOIs marked as not valid are passed over."""
    w, none = F.col("w"), F.lit(None).cast("string")
    df = df.withColumn("w", medline_fields("payload")).withColumn("_pmid", filled(clean_text(w["pmid"]))).withColumn("_pdf", none)
    if open_access is not None:
        links = open_access.groupBy(F.col("pmid").cast("string").alias("_pmid")).agg(F.min("pdf_url").alias("_pdf"))
        df = df.drop("_pdf").join(links, "_pmid", "left")
    pmid = F.col("_pmid")
    name = lambda a: clean_text(F.concat_ws(" ", F.coalesce(filled(a["fore"]), a["initials"]), a["last"]))
    doi = F.try_element_at(F.filter(F.transform(w["dois"], normalize_doi), lambda d: d.isNotNull()), F.lit(1))
    year = F.try_element_at(F.filter(F.transform(w["years"], lambda y: F.regexp_extract(y, r"^\s*(\d{4})", 1)), lambda y: y != ""), F.lit(1)).try_cast("int")
    return make_paper(
        df, paper_id=F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("pmid:"), pmid)), title=w["title"], authors=F.filter(F.transform(w["authors"], name), lambda n: n != ""), year=year, venue=w["journal"],
        abstract=w["abstract"], url=F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")), pdf_url=F.col("_pdf"), doi=doi, source=F.lit("pubmed"),
    )


PARSERS = {"openalex": parse_openalex, "semantic_scholar": parse_semantic_scholar, "crossref": parse_crossref, "arxiv": parse_arxiv, "pubmed": parse_pubmed}


def fan_out(payloads: DataFrame, sources: tuple[str, ...], open_access: DataFrame | None = None) -> DataFrame:
    """Records of payloads (source, query, payload, pos) as a bag union over the sources in order; unknown sources give nothing.

    ``open_access`` (pmid, pdf_url) fills the links of Medline articles.
    """
    more = {"pubmed": {"open_access": open_access}}
    parts = [PARSERS[s](payloads.filter(F.col("source") == s).drop("source"), **more.get(s, {})) for s in sources if s in PARSERS]
    if not parts:
        return make_paper(payloads.limit(0), source=F.lit(""))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


__all__ = ["PARSERS", "blank", "fan_out", "make_paper", "title_fingerprint"]
