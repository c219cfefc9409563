"""Fixed schemas of the record tables, as DDL."""

from __future__ import annotations

FULLTEXT_STRUCT = (
    "struct<title:string,abstract:string,keywords:array<string>,"
    "sections:array<struct<heading:string,level:int,text:string>>,"
    "tables:array<struct<caption:string,rows:array<string>>>,"
    "figures:array<struct<caption:string>>,n_pages:int,parse_method:string>"
)
PAPERS = (
    "pos bigint, paper_id string, title string, authors array<string>, year int, venue string, citation_count bigint, "
    "abstract string, url string, pdf_url string, doi string, source string, fulltext string, score double, "
    "matched_queries array<string>, relevance double, has_fulltext boolean, fulltext_chars int, "
    f"fulltext_struct {FULLTEXT_STRUCT}, openalex_id string, referenced_works array<string>, hub_score double, bridge_score double"
)
EVIDENCE = "paper_id string, claim string, method string, dataset string, metric string, section string"
CLUSTERS = "cluster_id int, label string, keywords array<string>, paper_ids array<string>, size int"
CITATIONS = "paper_id string, n int"
SECTIONS = "ord int, title string, body string"
CLAIMS = "section string, claim_ix int, text string, paper_ids array<string>, confidence string"
EDGES = "src string, dst string"
RUN_ERRORS = "node string, error string, kind string, time string"
#: Fields of a record that the store keeps; full text is not among them.
PERSISTED = ("paper_id", "title", "authors", "year", "venue", "citation_count", "abstract", "url", "pdf_url", "doi", "source", "matched_queries", "relevance", "openalex_id", "referenced_works")
