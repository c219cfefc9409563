"""Every operator of the record engine as a query over the synthetic tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import bibliography, citations, identifiers, jsonfix, text
from ..operators import audit, dedup, enrich, graph, ranking, record_store, sections, tfidf, topics
from ..sources import payloads, works_source
from ..storage import Store, scratch_root
from .fixtures import QUERIES, TOPIC, flow_edges, flow_nodes, order_references, papers_docs, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a function under its own name."""
    REGISTRY[f.__name__] = f
    return f


@query
def ident_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOI, versioned id and title fingerprint forms."""
    k = F.col("o_orderkey").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/ABC"), k)).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("doi:10.1364/ao."), k, F.lit(". "))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("not a doi "), k)).otherwise(F.concat(F.lit(" HTTP://DOI.ORG/10.1109/"), k))
    aid = F.concat(F.lit("2301."), k, F.when(F.col("o_orderkey") % 3 == 0, "v2").otherwise(""))
    title = F.concat("o_orderpriority", F.lit(" Is All-You Need! "), k)
    return table(spark, sf_dir, "orders").select("o_orderkey", identifiers.normalize_doi(raw).alias("doi"), identifiers.unversioned_id(aid).alias("arxiv_id"), identifiers.title_fingerprint(title).alias("fingerprint"))


@query
def text_clean_condense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned and condensed texts and slugs."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_text(t)).alias("clean_md5"), F.md5(text.condense(t)).alias("condensed_md5"), text.slug(text.first_line(t)).alias("slug"), F.md5(text.clean_fulltext(t)).alias("fulltext_md5"))


@query
def markup_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_markup(F.col("html"))).alias("text_md5"))


@query
def inverted_index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts rebuilt from word positions."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"\s+")).alias("p", "w")).filter("w <> ''")
    index = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("ix"))
    return index.select("item_id", identifiers.rebuild_abstract(F.col("ix")).alias("abstract"))


@query
def semi_structured_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON payloads with a fixed schema."""
    p = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(p["k"], F.lit(0)).cast("long").alias("k"), F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("paper_id"))


@query
def query_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search syntax and safe filter values from first lines."""
    line = text.first_line(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", identifiers.arxiv_query(line).alias("arxiv_query"), identifiers.filter_value(line).alias("filter_value"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers of five sources and of one that no parser knows: JSON works, Atom entries and Medline articles."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    k, title, year = n.cast("string"), F.concat(F.lit("On  "), F.md5("text")), 2000 + n % 25
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    odd = n % 2 == 1
    openalex = F.to_json(F.struct(
        text("https://x.org/W", k).alias("id"), F.when(odd, text("https://doi.org/10.1/A", k)).alias("doi"), title.alias("display_name"), year.alias("publication_year"), (n % 500).alias("cited_by_count"),
        F.expr("map('first', array(0), 'words', array(1, 3), 'of', array(2))").alias("abstract_inverted_index"), F.array(F.struct(F.struct(text("N ", k).alias("display_name")).alias("author"))).alias("authorships"), F.array(text("https://x.org/W", n + 6)).alias("referenced_works"),
    ))
    scholar = F.to_json(F.struct(
        k.alias("paperId"), title.alias("title"), F.col("source").alias("abstract"), year.alias("year"), F.lit("A venue").alias("venue"), (n % 500).alias("citationCount"), F.struct(F.when(n % 4 == 0, text("doi:10.1/B", k)).alias("DOI"), F.when(odd, text("2301.", k, "v3")).alias("ArXiv")).alias("externalIds"),
        F.array(F.struct(F.lit("").alias("name")), F.struct(text("Q  ", k).alias("name"))).alias("authors"),
    ))
    dated = F.struct(F.array(F.array(year.cast("int"), F.lit(2))).alias("date-parts"))
    crossref = F.to_json(F.struct(
        text("10.2/", k).alias("DOI"), F.array(title).alias("title"), text("<jats:p>things of ", k, " .</jats:p>").alias("abstract"), (n % 500).alias("is-referenced-by-count"), F.array(F.lit("J")).alias("container-title"),
        F.array(F.struct(F.lit("G").alias("given"), text("F", k).alias("family"))).alias("author"), F.when(odd, dated).alias("issued"), dated.alias("created"),
    ))
    atom = text("<entry xmlns='http://www.w3.org/2005/Atom'><id>http://arxiv.org/abs/2301.", k, "v2</id><title>", title, "</title><published>", year, "-01-02</published><author><name>X ", k, "</name></author><summary> an  abstract </summary></entry>")
    medline = text(
        "<PubmedArticle><PMID>", k, "</PMID><Article><ArticleTitle>", title, "</ArticleTitle><Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>", year,
        " Jan</MedlineDate></PubDate></JournalIssue></Journal><AuthorList><Author><LastName>L", k, "</LastName><ForeName>Fo</ForeName></Author><Author><LastName>Group</LastName></Author><Author><Initials>Y Z</Initials><LastName>Last</LastName></Author></AuthorList><ELocationID EIdType='doi' ValidYN='N'>10.3/no</ELocationID><ELocationID EIdType='doi'>10.3/", k, "</ELocationID></Article></PubmedArticle>",
    )
    broken = n % 97 == 0
    source = F.element_at(F.array(*(F.lit(x) for x in SOURCES)), (n % 6 + 1).cast("int"))
    payload = F.when(broken & (n % 6 == 3), F.substring(atom, 1, 150)).when(broken & (n % 6 == 4), text(medline, "<Article>")).when(broken, "{").when(n % 6 == 0, openalex).when(n % 6 == 1, scholar).when(n % 6 == 2, crossref).when(n % 6 == 3, atom).when(n % 6 == 4, medline).otherwise("{}")
    return d.select(source.alias("source"), F.lit("q").alias("query"), payload.alias("payload"), n.alias("pos"))


#: Sources of the payloads above, the last of them unknown.
SOURCES = ("openalex", "semantic_scholar", "crossref", "arxiv", "pubmed", "elsewhere")


@query
def source_fanout_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all sources' payloads as a bag union; unknown sources give nothing, damaged payloads no title."""
    found = payloads.fan_out(_payloads(spark, sf_dir), SOURCES)
    return found.select(
        "pos", "source", "paper_id", "title", F.col("year").cast("long").alias("year"), "venue", "citation_count", "abstract", "doi", F.array_join("authors", "|").alias("authors"), F.coalesce("pdf_url", F.lit("")).alias("pdf_url"),
        "openalex_id", F.array_join("referenced_works", "|").alias("refs"), F.array_join("matched_queries", "|").alias("queries"),
    )


@query
def source_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open works of three kinds from 2010 on, by predicates that the source answers, as records."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.element_at(F.array(*(F.lit(t) for t in (*works_source.TYPES, "dataset"))), (n % 4 + 1).cast("int"))
    link = F.concat(F.lit("https://x.org/W"), n.cast("string"))
    answers = d.select(
        link.alias("id"), kind.alias("type"), F.concat(F.lit("On "), F.md5("text")).alias("display_name"), F.when(n % 11 != 0, 2000 + n % 25).alias("publication_year"), (n % 500).alias("cited_by_count"),
        F.struct((n % 3 == 0).alias("is_oa"), F.concat(link, F.lit(".pdf")).alias("oa_url")).alias("open_access"),
    )
    path = f"{scratch_root(spark)}/citeweave/works-{uuid.uuid4().hex[:12]}"
    answers.write.option("maxRecordsPerFile", 100 * works_source.MOST_PAGE).json(path)
    found = works_source.search_works(spark, path, min_year=2010, oa_only=True)
    records = payloads.parse_openalex(found.select("payload", F.lit("q").alias("query"), F.substring_index("id", "W", -1).cast("long").alias("pos")))
    return records.select("pos", "paper_id", "title", F.col("year").cast("long").alias("year"), "citation_count", "pdf_url")


@query
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every titled record."""
    return dedup.assign_groups(papers_docs(spark, sf_dir)).select("pos", "group_id")


@query
def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records."""
    out = dedup.dedup_papers(papers_docs(spark, sf_dir).drop("lang"))
    return out.select("pos", "paper_id", F.md5("abstract").alias("abstract_md5"), "citation_count", F.col("year").cast("long").alias("year"), "source", F.array_join("matched_queries", "|").alias("queries"))


@query
def dedup_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered fold on records with bridging keys: DOIs by customer, titles by order date."""
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    papers = o.select(
        F.col("o_orderkey").alias("pos"), F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("paper_id"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("10.1/"), F.col("o_custkey").cast("string"))).alias("doi"),
        F.concat(F.lit("Report of day "), day, F.col("o_orderpriority")).alias("title"),
    )
    return dedup.assign_groups(papers).select("pos", "group_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.relevance(papers_docs(spark, sf_dir), TOPIC, list(QUERIES))


@query
def tfidf_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every record with the topic."""
    return _scored(spark, sf_dir).select("pos", F.round("relevance", 5).alias("relevance"))


@query
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate with its floor over rounded scores."""
    scored = _scored(spark, sf_dir).withColumn("relevance", F.round("relevance", 4))
    gated = ranking.gate(scored, 0.4, 20).filter("kept")
    return gated.select("pos", "relevance")


@query
def composite_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite score of every record."""
    scored = _scored(spark, sf_dir).withColumn("hub_score", (F.col("pos") % 10) / 10.0)
    return ranking.rank(scored, len(QUERIES)).select("pos", "score")


@query
def pool_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool's cap: the 120 most cited records, stable in position."""
    return ranking.top_ranked(papers_docs(spark, sf_dir).withColumn("score", F.col("citation_count").cast("double")), Settings().pool_cap).select("pos", "score")


@query
def prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion terms from the twelve most cited records."""
    papers = papers_docs(spark, sf_dir).withColumn("relevance", F.lit(0.0)).withColumn("score", F.lit(0.0))
    return ranking.expansion_terms(papers).select("term", "kind", F.round("score", 5).alias("score"))


@query
def prf_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen expansion queries."""
    papers = papers_docs(spark, sf_dir).withColumn("relevance", F.lit(0.0)).withColumn("score", F.lit(0.0))
    picked = ranking.expand_queries(papers, TOPIC, list(QUERIES))
    return spark.createDataFrame(list(enumerate(picked)), "i long, query string")


@query
def oa_target_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-access predicates and full-text resolution over page addresses."""
    pages = table(spark, sf_dir, "pages")
    wall = F.array(*(F.lit(f"https://{p}/") for p in enrich.PAYWALLED))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.element_at(wall, (F.col("page_id") % 5 + 1).cast("int")), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.col("url"))
    doi = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("page_id").cast("string")))
    papers = pages.select("page_id", url.alias("pdf_url"), doi.alias("doi"))
    places = papers.filter("doi is not null and page_id % 4 = 0").select("doi", F.concat(F.lit("https://oa.example/"), F.col("page_id").cast("string")).alias("pdf_url"), F.lit(None).cast("string").alias("licence"))
    return enrich.resolve_fulltext(papers, places).select("page_id", enrich.oa_available(F.col("pdf_url"), F.col("doi")).alias("oa"), "text_url", "licence")


@query
def fulltext_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight records with open access first."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("pdf_url"), F.lit(None).cast("string").alias("doi"), F.when(F.col("page_id") % 6 == 0, "has text").alias("fulltext"))
    return ranking.fulltext_targets(pages).select("pos")


@query
def citation_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation counts looked up by title for records without one."""
    papers = papers_docs(spark, sf_dir).withColumn("citation_count", F.when(F.col("pos") % 2 == 0, 0).otherwise(F.col("citation_count")))
    lookup = papers_docs(spark, sf_dir).select("doi", "title", "citation_count")
    n = papers.count()
    return enrich.enrich_citations(papers, lookup, n).select("pos", "citation_count")


@query
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per year."""
    return audit.year_histogram(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"))).select(F.col("year").cast("long").alias("year"), "n")


@query
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span of years."""
    return audit.year_range(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))


@query
def edges_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from reference lists given as addresses."""
    e = flow_edges(spark, sf_dir)
    refs = e.groupBy("src").agg(F.collect_list(F.concat(F.lit("https://index.example/W"), F.col("dst").cast("string"))).alias("referenced_works"))
    papers = flow_nodes(spark, sf_dir).join(refs, F.col("node") == F.col("src"), "left").select(F.col("node").alias("pos"), F.concat(F.lit("p"), F.col("node").cast("string")).alias("paper_id"), F.concat(F.lit("W"), F.col("node").cast("string")).alias("openalex_id"), "referenced_works")
    return graph.edges_of(papers)


@query
def pagerank_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank and its scaled hub score."""
    nodes, edges = flow_nodes(spark, sf_dir), flow_edges(spark, sf_dir)
    ranks = graph.pagerank(nodes, edges)
    hubs = graph.scaled(ranks, "rank", True, "hub_score")
    return ranks.join(hubs, "node").select("node", F.round("rank", 6).alias("rank"), "hub_score")


@query
def pagerank_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PageRank where every third nation has no way out."""
    return graph.pagerank(flow_nodes(spark, sf_dir), flow_edges(spark, sf_dir).filter("src % 3 <> 0")).select("node", F.round("rank", 6).alias("rank"))


@query
def betweenness_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness over the undirected graph."""
    return graph.betweenness(flow_nodes(spark, sf_dir), flow_edges(spark, sf_dir)).select("node", F.round("between", 4).alias("between"))


@query
def coupling_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share at least two parts."""
    return graph.coupling_pairs(order_references(spark, sf_dir), rows=table(spark, sf_dir, "lineitem").count())


@query
def coupling_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupled groups outside urgent orders."""
    covered = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("paper"))
    return graph.coupling_gaps(order_references(spark, sf_dir), covered, rows=table(spark, sf_dir, "lineitem").count())


@query
def graph_export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and best nodes of the graph."""
    nodes, edges = flow_nodes(spark, sf_dir), flow_edges(spark, sf_dir)
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return graph.graph_stats(nodes, edges, degree)


@query
def hub_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High hubs among the dropped."""
    papers = papers_docs(spark, sf_dir).withColumn("hub_score", (F.col("pos") % 10) / 10.0)
    return ranking.dropped_hubs(papers, papers.filter("citation_count >= 100")).select("pos", "hub_score")


@query
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version of customers over the first."""
    c = table(spark, sf_dir, "customer")
    old = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), "c_acctbal")
    twice = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("seq"))
    last = c.filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") + 2).alias("c_acctbal"), F.lit(2).alias("seq"))
    return record_store.upsert(old, twice.unionByName(last)).select("key", F.round("c_acctbal", 2).alias("balance"))


@query
def store_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank fields of customers' records filled from the store."""
    c = table(spark, sf_dir, "customer")
    none, key = F.lit(None).cast("string"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string"))
    common = {"doi": none, "pdf_url": none, "openalex_id": none, "referenced_works": F.array().cast("array<string>"), "title": F.lit("")}
    own = c.select("c_custkey", key.alias("paper_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("abstract"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("venue"), F.lit(0).cast("long").alias("citation_count"), F.lit(None).cast("int").alias("year"), F.array("c_name").alias("authors"), *(v.alias(k) for k, v in common.items()))
    kept = c.filter("c_custkey % 5 <> 0").select(key.alias("key"), F.concat(F.lit("stored "), "c_name").alias("abstract"), F.concat(F.lit("stored "), "c_mktsegment").alias("venue"), F.col("c_custkey").alias("citation_count"), F.lit(2001).alias("year"), F.array("c_name", "c_mktsegment").alias("authors"), *(v.alias(k) for k, v in common.items()))
    return record_store.hydrate(own, kept).select("c_custkey", "abstract", "venue", "citation_count", F.col("year").cast("long").alias("year"), F.array_join("authors", "|").alias("authors"))


@query
def store_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    found = record_store.recall(docs, asked, 10)
    best = found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("best"), F.round(F.sum("score"), 3).alias("total"))
    return best


@query
def topic_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster counts for the sizes of the labelled groups."""
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(F.col("label").cast("long").alias("label"), "n", topics.chosen_k(F.col("n")).cast("long").alias("k"))


@query
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of the languages as clusters."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("cluster"), "text")
    v = tfidf.Vectorizer(ngrams=1, max_features=8000, stop_words=(*tfidf.STOP_WORDS, *topics.TOPIC_STOP), sublinear=True, max_df=0.85)
    return topics.keywords(docs, v=v).select("cluster", F.col("rn").cast("long").alias("rn"), "term", F.round("mean", 5).alias("mean"))


@query
def topic_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in ten clusters, renumbered by size."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return topics.renumber(topics.kmeans(vectors, 10)).select("doc", "cluster_id")


@query
def topic_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's silhouette among the labels as clusters."""
    sound = "label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"
    vectors = table(spark, sf_dir, "embeddings").filter(sound)
    rows = vectors.select(F.col("vec_id").alias("doc"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("label").cast("int").alias("cluster"))
    width = rows.agg(F.max("cluster")).first()[0]
    found = topics.silhouettes(rows, {"cluster": (width or 0) + 1})
    return found.select("doc", F.round("cluster", 6).alias("silhouette"))


@query
def citation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of records new to a version."""
    p = papers_docs(spark, sf_dir)
    code = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    members = p.select("paper_id", code.alias("cluster_id"), F.col("citation_count").cast("double").alias("score"), "pos")
    existing = p.filter("pos % 10 = 0").select("paper_id", (F.col("pos") / 10 + 1).cast("long").alias("n"))
    return topics.number_citations(members, existing)


@query
def incremental_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as current clusters, languages of even documents as previous ones."""
    p = papers_docs(spark, sf_dir)
    written = p.select(F.col("lang").alias("cluster")).distinct().filter("cluster <> 'de'")
    out = topics.match_versions(p.select(F.col("source").alias("cluster"), "paper_id"), p.filter("pos % 2 = 0").select(F.col("lang").alias("cluster"), "paper_id"), written, 0.3)
    return out.select("cluster", "prev", F.round("ratio", 6).alias("ratio"), "kept")


@query
def section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents whose every fifth line is made a numbered heading."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    marked = F.array_join(F.transform(lines, lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("2."), ((i / 5).cast("int") + 1).cast("string"), F.lit(" Part"))).otherwise(x)), "\n")
    parts = sections.sections_of(docs.select("doc_id", marked.alias("text")), "doc_id")
    return parts.select(F.col("doc").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "heading", F.col("level").cast("long").alias("level"), F.length("text").cast("long").alias("chars"))


@query
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and figures of documents with captions, rows, headings and blank lines put between their lines."""
    put = F.when(F.col("doc_id") % 3 == 0, "Table 1: of runs\nover two seeds\nA  1  2\nB  3  4").when(F.col("doc_id") % 3 == 1, "Fig. 2  of parts\n\nResults\n| a | 1 |").otherwise("tab. 3 alone\n\n\none more line\n7 of 9 in 11 runs\nx | y\nFigure 4\n")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 1, F.concat(x, F.lit("\n"), put)).otherwise(x))
    docs = table(spark, sf_dir, "documents")
    found = sections.detect_tables(docs.select("doc_id", F.array_join(lines, "\n").alias("text")), "doc_id", parts=tfidf.text_parts(docs)[1])
    chars = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + F.length(x["caption"])).cast("long")
    rows = F.aggregate("tables", F.lit(0), lambda a, t: a + F.size(t["rows"])).cast("long")
    return found.select(F.col("doc").alias("doc_id"), F.size("tables").cast("long").alias("n_tables"), F.size("figures").cast("long").alias("n_figures"), rows.alias("n_rows"), chars(F.col("tables")).alias("table_chars"), chars(F.col("figures")).alias("figure_chars"))


def _marked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    mark = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    body = F.concat("text", F.lit(" "), mark(F.col("turn") + 1), F.lit(" and "), mark(F.col("conv_id") % 120), F.lit(" "), mark(F.col("turn") + 1), F.lit(" end"))
    return c.select("conv_id", "turn", body.alias("body"))


@query
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited numbers of every turn."""
    return _marked_turns(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(citations.cited_numbers(F.col("body")), lambda n: n.cast("string")), ",").alias("cited"))


@query
def citation_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without marks beyond the first five numbers."""
    return _marked_turns(spark, sf_dir).select("conv_id", "turn", F.md5(citations.strip_invalid(F.col("body"), F.array(*(F.lit(i) for i in range(1, 6))))).alias("body_md5"))


@query
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of labelled documents with ids, numbers and unknown ids."""
    lab = table(spark, sf_dir, "labels")
    claims = lab.select(
        F.lit("s").alias("section"), F.col("doc_id").alias("claim_ix"), F.lit("t").alias("text"),
        F.array(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("doc_id").cast("string"), F.lit("nope")).alias("paper_ids"),
        F.when(F.col("quality") == 1, "HIGH").when(F.col("toxic") == 1, "low").otherwise("unsure").alias("confidence"),
    )
    cites = lab.filter("doc_id % 2 = 0").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("paper_id"), (F.col("doc_id") + 1).alias("n"))
    return audit.ground_claims(claims, cites).select("claim_ix", "confidence", "paper_id", F.col("i").cast("long").alias("i"))


@query
def faithfulness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of supported claims, quality as the verdict."""
    return audit.faithfulness(table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 0, "Unsupported").when(F.col("toxic") == 1, "partial").otherwise("supported").alias("verdict")))


def _inputs(spark: SparkSession, sf_dir: str) -> audit.ScoreInputs:
    docs, lab = papers_docs(spark, sf_dir), table(spark, sf_dir, "labels")
    faith = faithfulness_score(spark, sf_dir)
    secs = _marked_turns(spark, sf_dir).select(F.when(F.col("turn") % 2 == 0, F.col("body")).otherwise("none").alias("body"))
    clusters = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    claims = lab.select(F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "low").otherwise("medium").alias("confidence"))
    return audit.ScoreInputs(docs, secs, clusters, claims, faith, 75, 1, 2, 2024)


def _dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scorecard(_inputs(spark, sf_dir))


@query
def quality_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six dimensions."""
    return _dimensions(spark, sf_dir).select("dimension", F.col("score").cast("long").alias("score"), F.col("weight").cast("double").alias("weight"), "available")


@query
def quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overall score and grade."""
    return audit.overall(_dimensions(spark, sf_dir)).select(F.col("overall").cast("long").alias("overall"), "grade")


def _with_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    doi = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("10.1364/ao."), F.col("pos").cast("string"))).when(F.col("pos") % 4 == 1, F.concat(F.lit("10.1109/"), F.col("pos").cast("string")))
    venue = F.when(F.col("pos") % 3 == 0, "arXiv preprint").when(F.col("pos") % 3 == 1, "Proceedings of A & B_C").otherwise("")
    return papers_docs(spark, sf_dir).withColumn("doi", doi).withColumn("venue", venue)


@query
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BibTeX entries with their keys."""
    p = _with_dois(spark, sf_dir)
    base = p.select("pos", bibliography.cite_key_base(F.col("authors"), F.col("year"), F.col("title")).alias("base"))
    keys = audit.number_entries(base)
    c = F.col
    entry = bibliography.bibtex_entry(c("key"), c("paper_id"), c("title"), c("authors"), c("year"), c("venue"), c("doi"), c("url"), c("source"))
    return p.join(keys, "pos").select("pos", "key", F.md5(entry).alias("entry_md5"))


@query
def reference_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the reference list."""
    c = F.col
    line = bibliography.reference_line(c("pos") + 1, c("authors"), c("year"), c("title"), c("venue"), c("citation_count"), c("doi"), c("url"))
    return _with_dois(spark, sf_dir).select("pos", line.alias("line"))


@query
def evidence_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence lines of the fifteen most cited records of each source."""
    p = papers_docs(spark, sf_dir)
    order = Window.partitionBy("source").orderBy(F.col("citation_count").desc(), "pos")
    members = p.select(F.col("source").alias("cluster"), (F.row_number().over(order) - 1).alias("i"), "paper_id")
    lab = table(spark, sf_dir, "labels").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("paper_id"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("claim"), F.lit("").alias("method"), F.when(F.col("toxic") == 1, "toxic").alias("dataset"), F.lit(None).cast("string").alias("metric"))
    cites = p.filter("pos % 2 = 0").select("paper_id", F.col("pos").alias("n"))
    return audit.evidence_blocks(members, p, lab, cites).select("cluster", F.col("i").cast("long").alias("i"), F.md5("line").alias("line_md5"))


@query
def papers_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported records: citation numbers, and the full text as its presence and length."""
    p = papers_docs(spark, sf_dir).withColumn("fulltext", F.when(F.col("pos") % 2 == 0, F.col("abstract")))
    cites = p.filter("pos % 3 = 0").select("paper_id", (F.col("pos") / 3 + 1).cast("long").alias("citation_index"))
    out = audit.exported(p, cites)
    return out.select("paper_id", F.length("title").cast("long").alias("title_chars"), F.length("abstract").cast("long").alias("abstract_chars"), "has_fulltext", F.col("fulltext_chars").cast("long").alias("fulltext_chars"), "citation_index")


@query
def year_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of the last twelve years as text."""
    return audit.year_text(table(spark, sf_dir, "documents").select((1990 + F.col("doc_id") % 30).cast("int").alias("year")))


@query
def quality_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaknesses and highlights of the scorecard."""
    return audit.remarks(_inputs(spark, sf_dir), ["Hub one", "Hub two"], 2)


@query
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts of parsed texts whose lines stand under preferred, skipped and other headings."""
    d = table(spark, sf_dir, "documents")
    names = F.array(*(F.lit(x) for x in ("Methods", "References", "2. Results", "Thanks", "Discussion")))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x, i: F.struct(F.element_at(names, (i % 5 + 1).cast("int")).alias("heading"), F.lit(1).alias("level"), F.trim(x).alias("text")))
    captions = F.array(F.struct(F.lit("Fig. 1 of it").alias("caption")))
    none = F.array().cast("array<struct<caption:string,rows:array<string>>>")
    parsed = F.struct(F.when(F.col("doc_id") % 2 == 0, "An abstract.").otherwise("").alias("abstract"), lines.alias("sections"), captions.alias("figures"), none.alias("tables"))
    return d.select("doc_id", F.md5(F.coalesce(sections.extract_body(parsed, 900), F.lit("-"))).alias("extract_md5"))


@query
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of damaged answers built from events."""
    props = F.expr("substring(props, 1, length(props) - 1)")
    answer = F.concat(F.lit("Here:\n```json\n"), props, F.lit(", \"id\": "), F.col("event_id").cast("string"), F.lit(",}\n``` done"))
    fixed = jsonfix.repair_json(answer)
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(fixed, "$.k").cast("long").alias("k"), F.get_json_object(fixed, "$.id").cast("long").alias("id"))


@query
def search_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, resolve, score, rank, cut: the twenty best records for a topic."""
    _, parts = tfidf.text_parts(table(spark, sf_dir, "documents"))
    pool = Store(spark, "search", parts).put(dedup.dedup_papers(papers_docs(spark, sf_dir).drop("lang")), "pool")
    scored = ranking.relevance(pool, TOPIC, list(QUERIES)).withColumn("hub_score", F.lit(0.0))
    top = ranking.top_ranked(ranking.rank(scored, len(QUERIES)), 20)
    return top.select("paper_id", "title", F.col("year").cast("long").alias("year"), "citation_count", "score")
