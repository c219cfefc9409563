"""Claims against their evidence, faithfulness, evidence blocks and the quality scorecard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import has_citation
from ..functions.text import filled


def ground_claims(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(section, claim_ix, text, paper_id, i, confidence): cited ids that exist, as ids or as their numbers.

    Order and first occurrences are kept; claims left without an id vanish;
    confidence other than high, medium or low is medium.
    """
    level = F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    tidy = claims.select("section", "claim_ix", "text", F.when(level.isin("high", "medium", "low"), level).otherwise("medium").alias("confidence"), F.posexplode("paper_ids").alias("i", "ref"))
    by_id = citations.select(F.col("paper_id").alias("ref"), F.col("paper_id").alias("p1"))
    by_number = citations.groupBy(F.col("n").cast("string").alias("ref")).agg(F.max("paper_id").alias("p2"))
    found = tidy.join(by_id, "ref", "left").join(by_number, "ref", "left").withColumn("paper_id", F.coalesce("p1", "p2")).filter("paper_id is not null")
    return found.groupBy("section", "claim_ix", "text", "confidence", "paper_id").agg(F.min("i").alias("i"))


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """One row: checked, flagged and the share not judged unsupported (to 3 places); partial counts as supported."""
    bad = F.startswith(F.lower(F.trim(F.coalesce("verdict", F.lit("")))), F.lit("unsupp"))
    return verdicts.agg(F.count(F.lit(1)).alias("checked"), F.count(F.when(bad, 1)).alias("flagged"), F.round(F.avg(F.when(bad, 0.0).otherwise(1.0)), 3).alias("score"))


def evidence_blocks(members: DataFrame, papers: DataFrame, evidence: DataFrame, citations: DataFrame, limit: int = 15) -> DataFrame:
    """(cluster, i, line) of the first ``limit`` members (cluster, i, paper_id) of each cluster; unknown papers are skipped."""
    first = members.filter(F.col("i") < limit)
    joined = first.join(papers.select("paper_id", "title", "year", "citation_count", "abstract"), "paper_id").join(evidence.select("paper_id", "claim", "method", "dataset", "metric"), "paper_id", "left").join(citations, "paper_id", "left")
    head = F.concat(F.lit("["), F.coalesce(F.col("n").cast("string"), F.lit("None")), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit(", 被引 "), F.coalesce("citation_count", F.lit(0)).cast("string"), F.lit(")"))
    claim = F.concat(F.lit("    结论: "), F.coalesce(filled(F.col("claim")), F.substring(F.coalesce("abstract", F.lit("")), 1, 180)))
    extra = [F.when(filled(F.col(c)).isNotNull(), F.concat(F.lit(f"    {name}: "), F.col(c))) for c, name in (("method", "方法"), ("dataset", "数据"), ("metric", "指标"))]
    return joined.select("cluster", "i", F.array_join(F.array_compact(F.array(head, claim, *extra)), "\n").alias("line"))


# The weight of each dimension of the scorecard.
DIMENSION_WEIGHTS = {"faithfulness": 0.25, "citation_coverage": 0.20, "network_hub": 0.15, "topic_balance": 0.20, "recency": 0.10, "grounding": 0.10}


@dataclass
class ScoreInputs:
    """What the scorecard reads; frames may be None where a part did not run."""

    papers: DataFrame
    sections: DataFrame
    clusters: DataFrame
    claims: DataFrame
    faithfulness: DataFrame | None
    edge_count: int
    dropped_hubs: int
    gap_count: int
    as_of_year: int


def scorecard(x: ScoreInputs) -> DataFrame:
    """(dimension, score, weight, available), scores half-even rounded."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c))
    percent = lambda c: clamp(F.bround(c * 100, 0).cast("int"))
    spark = x.papers.sparkSession

    def row(frame: DataFrame, name: str, score, available) -> DataFrame:
        return frame.select(F.lit(name).alias("dimension"), F.coalesce(score, F.lit(0)).cast("int").alias("score"), F.lit(DIMENSION_WEIGHTS[name]).alias("weight"), available.alias("available"))

    faith = x.faithfulness if x.faithfulness is not None else spark.range(0).select(F.lit(0.0).alias("score"), F.lit(0).alias("checked"))
    f = faith.agg(F.max("score").alias("s"), F.max("checked").alias("c"))
    s = x.sections.agg(F.avg(has_citation(F.col("body")).cast("double")).alias("s"), F.count(F.lit(1)).alias("c"))
    hub = 60 if x.edge_count <= 0 else max(0, 100 - min(60, 30 * x.dropped_hubs))
    b = x.clusters.agg(F.stddev_pop("size").alias("sd"), F.avg("size").alias("m"), F.count(F.lit(1)).alias("c"))
    balance = F.when((F.col("m") > 0) & (F.col("c") > 1), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / F.col("m")))).otherwise(1.0)
    topic = percent(balance)
    topic = clamp(F.bround(topic * 0.85, 0).cast("int")) if x.gap_count else topic
    y = x.papers.filter(F.coalesce("year", F.lit(0)) != 0).agg(F.avg((F.col("year") >= x.as_of_year - 5).cast("double")).alias("s"), F.count(F.lit(1)).alias("c"))
    strength = F.when(F.lower("confidence") == "high", 1.0).when(F.lower("confidence") == "low", 0.2).otherwise(0.6)
    g = x.claims.agg(F.avg(strength).alias("s"), F.count(F.lit(1)).alias("c"))
    out = row(f, "faithfulness", percent(F.col("s")), F.coalesce(F.col("c"), F.lit(0)) > 0)
    out = out.unionByName(row(s, "citation_coverage", percent(F.col("s")), F.col("c") > 0))
    out = out.unionByName(row(spark.range(1), "network_hub", F.lit(hub), F.lit(True)))
    out = out.unionByName(row(b, "topic_balance", F.when(F.col("c") > 0, topic), F.col("c") > 0))
    out = out.unionByName(row(y, "recency", percent(F.col("s")), F.col("c") > 0))
    return out.unionByName(row(g, "grounding", percent(F.col("s")), F.col("c") > 0))


def overall(dimensions: DataFrame) -> DataFrame:
    """One row: the weighted score over available dimensions and its grade."""
    score = F.coalesce(F.bround(F.sum(F.when(F.col("available"), F.col("score") * F.col("weight"))) / F.sum(F.when(F.col("available"), F.col("weight"))), 0), F.lit(0.0)).cast("int")
    return dimensions.agg(score.alias("overall")).withColumn("grade", F.when(F.col("overall") >= 85, "A").when(F.col("overall") >= 70, "B").when(F.col("overall") >= 55, "C").otherwise("D"))


def year_histogram(papers: DataFrame) -> DataFrame:
    """(year, n) of dated records."""
    return papers.filter(F.coalesce("year", F.lit(0)) != 0).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def year_range(papers: DataFrame, unknown: str = "未知") -> DataFrame:
    """One row with the span of years as text."""
    y = papers.filter(F.coalesce("year", F.lit(0)) != 0).agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return y.select(F.coalesce(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")), F.lit(unknown)).alias("year_range"))


def year_text(papers: DataFrame, buckets: int = 12) -> DataFrame:
    """One row: the last ``buckets`` years that records have with their counts, oldest first, as text."""
    last = year_histogram(papers).orderBy(F.col("year").desc()).limit(buckets)  # at most so many rows
    shown = F.transform(F.array_sort(F.collect_list(F.struct("year", "n"))), lambda s: F.concat(s["year"].cast("string"), F.lit(":"), s["n"].cast("string")))
    return last.agg(F.array_join(shown, ", ").alias("years"))


def exported(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """Records as they leave: ``citation_index`` of those in ``citations`` (paper_id, citation_index), and of the full text only whether and how long it is."""
    full = F.coalesce("fulltext", F.lit("")) if "fulltext" in papers.columns else F.lit("")
    out = papers.withColumn("has_fulltext", full != "").withColumn("fulltext_chars", F.length(full))
    return out.drop("fulltext", "fulltext_struct").join(citations.select("paper_id", "citation_index"), "paper_id", "left")


# The scores at which a dimension draws a remark.
WEAK_BELOW = {"faithfulness": 90, "citation_coverage": 80, "recency": 50, "grounding": 70}
STRONG_FROM, BALANCE_BELOW = 95, 60


def remarks(x: ScoreInputs, dropped: list[str], gaps: int) -> DataFrame:
    """(kind, i, text): weaknesses and highlights that the dimensions draw, in their order.

    Each rule is a condition over one row of scores and counts; ``dropped``
    names the hubs that the gate dropped.
    """
    spark = x.papers.sparkSession
    scores = scorecard(x).groupBy().pivot("dimension", list(DIMENSION_WEIGHTS)).agg(F.max(F.when(F.col("available"), F.col("score"))))
    faith = x.faithfulness.agg(F.max("flagged").alias("flagged")) if x.faithfulness is not None else spark.range(1).select(F.lit(0).alias("flagged"))
    bare = x.sections.agg(F.count(F.when(~F.coalesce(has_citation(F.col("body")), F.lit(False)), 1)).alias("bare"))
    spread = x.clusters.agg(F.count(F.lit(1)).alias("groups"), (100 * (1 - F.stddev_pop("size") / F.avg("size"))).alias("balance"))
    row = scores.crossJoin(faith).crossJoin(bare).crossJoin(spread)
    low = lambda name: F.col(name) < WEAK_BELOW[name]
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    names = "、".join(dropped[:3])
    c = F.col
    rules = [
        ("weakness", low("faithfulness"), text("引用-论断一致性 ", c("faithfulness"), "%：", c("flagged"), " 条论断疑似无充分支撑，建议补充引用或修订表述")),
        ("highlight", c("faithfulness") >= STRONG_FROM, F.lit("引用-论断一致性高，自检闭环可信")),
        ("weakness", low("citation_coverage"), text("引用覆盖 ", c("citation_coverage"), "%：", c("bare"), " 个小节缺少引用标注，建议补充支撑文献")),
        ("weakness", F.lit(x.edge_count > 0 and bool(dropped)), F.lit(f"高枢纽论文被剔除：{len(dropped)} 篇必引级工作（{names} 等）可能被遗漏，建议放宽闸门或手动纳入")),
        ("weakness", F.lit(gaps > 0) & (c("groups") > 0), F.lit(f"存在 {gaps} 个研究空白，建议针对性补检相关方向文献")),
        ("weakness", (c("groups") > 1) & (c("balance") < BALANCE_BELOW), F.lit("主题簇规模失衡，建议补充小规模方向文献或合并过细簇")),
        ("weakness", low("recency"), text("时效偏弱：近 5 年文献仅占 ", c("recency"), "%，建议补充最新进展")),
        ("weakness", low("grounding"), F.lit("部分论断证据强度弱（low 置信占比高），建议增强抽取或补充支撑证据")),
    ]
    drawn = F.array_compact(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), said.alias("text"))) for i, (kind, when, said) in enumerate(rules))))
    return row.select(F.explode(drawn).alias("r")).select("r.kind", F.col("r.i").cast("long").alias("i"), "r.text")


def number_entries(keys: DataFrame) -> DataFrame:
    """(pos, key) from (pos, base): repeats of a base get a, b, ... in order of position.

    This is the relational form; where a suffixed key may meet another record's
    own base, :func:`fold_cite_keys` gives the sequential rule for a
    bibliography that fits the driver.
    """
    order = Window.partitionBy("base").orderBy("pos")
    ranked = keys.withColumn("i", F.row_number().over(order))
    letter = F.when(F.col("i") > 1, character(F.lit(ord("a")) + F.col("i") - 2)).otherwise("")
    return ranked.select("pos", F.concat("base", letter).alias("key"))


def character(code: Column) -> Column:
    """The character of a code point, whole (SQL's own ``char`` takes the remainder by 256)."""
    tail = lambda shift: F.shiftright(code, shift).bitwiseAND(63) + 128
    byte = lambda c: F.lpad(F.hex(c), 2, "0")
    two = F.concat(byte(F.shiftright(code, 6) + 192), byte(tail(0)))
    three = F.concat(byte(F.shiftright(code, 12) + 224), byte(tail(6)), byte(tail(0)))
    four = F.concat(byte(F.shiftright(code, 18) + 240), byte(tail(12)), byte(tail(6)), byte(tail(0)))
    return F.unhex(F.when(code < 1 << 7, byte(code)).when(code < 1 << 11, two).when(code < 1 << 16, three).otherwise(four)).cast("string")


def fold_cite_keys(bases: list[str]) -> list[str]:
    """Keys in order: the base, or the base with the first letter that is still free."""
    out: list[str] = []
    seen: set[str] = set()
    for base in bases:
        key, i = base, 0
        while key in seen:
            key, i = base + chr(ord("a") + i), i + 1
        seen.add(key)
        out.append(key)
    return out
