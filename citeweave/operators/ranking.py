"""Relevance, the gate with its floor, composite ranking and expansion terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import bigrams, tokens
from ..storage import Store
from .tfidf import Vectorizer, cosine_scores

# Fixed value: words that expansion never proposes.
EXPANSION_STOP = frozenset(
    """
a an the of for and or to in on at by with from as is are be been being was were
this that these those we our their his her its their they them it he she you your
i me my us using used use uses based via can may also more most less such which who
whom whose than then thus there here between among within without over under above
below into onto upon during before after while if else when where why how what all
any each both either neither not no nor so too very just only own same other another
paper papers study studies method methods methodology approach approaches result
results proposed propose present presents presentation show shows shown demonstrate
demonstrates analysis analyses model models modeling data dataset datasets set sets
experiment experiments experimental system systems algorithm algorithms framework
novel new recent research work works using use via using
""".split()
)


def relevance(papers: DataFrame, topic: str, queries: list[str], v: Vectorizer = Vectorizer()) -> DataFrame:
    """Papers with unrounded ``relevance``: cosine of title twice and abstract with topic thrice and queries; the scores are written once."""
    text = F.concat_ws(" ", "title", "title", "abstract")
    scores = cosine_scores(papers.select("pos", text.alias("text")), " ".join([topic] * 3 + list(queries)), v, doc="pos")
    scores = Store(papers.sparkSession, "relevance").put(scores.withColumnRenamed("score", "relevance"), "scores")
    return papers.drop("relevance").join(scores, "pos")


def gate(papers: DataFrame, threshold: float, min_keep: int = 20, score: str = "relevance") -> DataFrame:
    """Papers with ``kept`` and ``gate_rank``: those at the threshold, filled up from the best of the rest.

    The floor only applies to pools above ``min_keep``; kept papers stay in
    input order, then come the fillers by score.
    """
    if threshold <= 0:
        return papers.withColumn("kept", F.lit(True)).withColumn("gate_rank", F.col("pos"))
    passes = F.col(score) >= threshold
    total, above = papers.select(F.count(F.lit(1)), F.count(F.when(passes, 1))).first()
    fill = max(0, min_keep - above) if total > min_keep else 0
    # At most min_keep fillers.
    fillers = papers.filter(~passes).orderBy(F.col(score).desc(), "pos").limit(fill).select("pos", F.row_number().over(Window.orderBy(F.col(score).desc(), "pos")).alias("_n"))
    marked = papers.join(F.broadcast(fillers), "pos", "left")
    order = F.when(passes, F.col("pos")).when(F.col("_n").isNotNull(), F.lit(1 << 60) + F.col("_n"))
    return marked.withColumn("kept", passes | F.col("_n").isNotNull()).withColumn("gate_rank", order).drop("_n")


def rank(papers: DataFrame, n_queries: int, settings: Settings = Settings()) -> DataFrame:
    """Papers with ``score``, the weighted blend of relevance, citations, recency, query coverage and hub score, rounded to 4 places.

    Set-wide maxima come from one aggregate row; records under the least year
    are dropped before they are taken.
    """
    pool = papers.filter(F.coalesce("year", F.lit(0)) >= settings.min_year) if settings.min_year else papers
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year"))
    top = pool.agg(
        F.max("relevance").alias("_rel"), F.max(F.coalesce("citation_count", F.lit(0))).alias("_cites"),
        F.min(year).alias("_y0"), F.max(year).alias("_y1"), F.max(F.coalesce("hub_score", F.lit(0.0))).alias("_hub"),
    )
    rel = F.when(F.col("_rel") > 0, F.col("relevance") / F.col("_rel")).otherwise(0.0)
    cites = F.log1p(F.coalesce("citation_count", F.lit(0))) / F.when(F.col("_cites") > 0, F.log1p("_cites")).otherwise(1.0)
    recency = F.when(F.col("_y0").isNull(), 0.5).otherwise((F.coalesce(year, F.col("_y0")) - F.col("_y0")) / F.greatest(F.lit(1), F.col("_y1") - F.col("_y0")))
    coverage = F.least(F.lit(1.0), F.size(F.array_distinct(F.coalesce("matched_queries", F.array().cast("array<string>")))) / F.lit(max(1, n_queries)))
    hub = F.when(F.col("_hub") > 0, F.coalesce("hub_score", F.lit(0.0)) / F.col("_hub")).otherwise(0.0)
    s = settings
    blend = s.weight_relevance * rel + s.weight_citations * cites + s.weight_recency * recency + s.weight_coverage * coverage + s.weight_hub * hub
    return pool.drop("score").crossJoin(F.broadcast(top)).withColumn("score", F.round(blend, 4)).drop("_rel", "_cites", "_y0", "_y1", "_hub")


def top_ranked(ranked: DataFrame, limit: int) -> DataFrame:
    """The best by score, stable in ``pos``."""
    return ranked.orderBy(F.col("score").desc(), "pos").limit(limit)


def expansion_terms(papers: DataFrame, top_k: int = 12) -> DataFrame:
    """(term, kind, score) mined from the best records: bigrams in at least two of them, then unigrams."""
    words = F.filter(tokens(F.concat_ws(" ", "title", "title", "abstract")), lambda w: ~w.isin(*sorted(EXPANSION_STOP)) & (F.length(w) >= 3))
    docs = papers.select("pos", "relevance", "score", "citation_count", words.alias("words"))
    n_docs = docs.count()
    df_all = docs.select("pos", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = df_all.select("term", (F.log(F.lit(n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    top = docs.orderBy(F.col("relevance").desc(), F.col("score").desc(), F.col("citation_count").desc(), "pos").limit(top_k)
    pairs = top.select("pos", F.explode(bigrams(F.col("words"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pos").alias("docs")).filter("docs >= 2")
    w1, w2 = F.substring_index("term", " ", 1), F.substring_index("term", " ", -1)
    left, right = idf.select(F.col("term").alias("w1"), F.col("idf").alias("i1")), idf.select(F.col("term").alias("w2"), F.col("idf").alias("i2"))
    two = pairs.withColumn("w1", w1).withColumn("w2", w2).join(left, "w1").join(right, "w2").select("term", F.lit("bigram").alias("kind"), (F.col("n") * F.col("i1") * F.col("i2")).alias("score"))
    single = top.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    one = single.join(idf, "term").select("term", F.lit("unigram").alias("kind"), (F.col("n") * F.col("idf")).alias("score"))
    return two.unionByName(one)


def pick_terms(candidates: list[tuple[str, str]], topic: str, existing: list[str], limit: int = 5) -> list[str]:
    """Greedy choice over (term, kind) in order: none that contains or is contained in a query, the topic or a chosen term."""
    taken = [topic.lower().strip(), *(q.lower().strip() for q in existing)]
    if "" in taken:
        return []  # the empty string lies in every term
    chosen: list[str] = []
    for kind in ("bigram", "unigram"):
        covered = {w for c in chosen for w in c.split()}
        for term, k in candidates:
            if len(chosen) >= limit:
                return chosen
            if k == kind and not any(term in t or t in term for t in [*taken, *chosen]) and not (kind == "unigram" and term in covered):
                chosen.append(term)
    return chosen


def expand_queries(papers: DataFrame, topic: str, existing: list[str], settings: Settings = Settings()) -> list[str]:
    """New queries by pseudo-relevance feedback; ties by term.  Candidates come from at most expand_top_k records."""
    if not settings.expand_enabled or not topic.strip():
        return []
    rows = expansion_terms(papers, settings.expand_top_k).orderBy("kind", F.col("score").desc(), "term").collect()
    return pick_terms([(r.term, r.kind) for r in rows], topic, existing, settings.expand_max_queries)


def dropped_hubs(papers: DataFrame, kept: DataFrame, alert: float = 0.6, limit: int = 10) -> DataFrame:
    """The first records by position that the gate dropped despite a high hub score."""
    return papers.filter(F.col("hub_score") >= alert).join(kept.select("paper_id"), "paper_id", "left_anti").orderBy("pos").limit(limit)


def fulltext_targets(papers: DataFrame, limit: int = 8) -> DataFrame:
    """The first records with open access first, less those whose text is there; the cut comes before the filter."""
    from .enrich import oa_available

    chosen = papers.withColumn("_oa", oa_available(F.col("pdf_url"), F.col("doi")).cast("int")).orderBy(F.col("_oa").desc(), "pos").limit(limit)
    return chosen.filter(F.coalesce("fulltext", F.lit("")) == "").drop("_oa")
