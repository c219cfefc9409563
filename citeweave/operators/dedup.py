"""Entity resolution: ordered first-hit grouping of records by keys, and field merging.

A record joins the group of the first of its keys (by priority) that an
earlier record has claimed, and claims those of its keys still free.  A key is
therefore claimed by the first record that holds it, and for that record's
group.  So a record has one *parent*, the first holder of its first key that an
earlier record holds, and its group is its parent's: the fold is a forest of
pointers to earlier records, and following them to their roots settles all
records at once, in as many rounds as the longest chain has binary digits.
Records with equal key lists always fall into one group, so each key list
counts once however many copies there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import entity_keys
from ..functions.text import blank, filled
from ..storage import Store
from .components import connected_components
from .joins import follow, lookup


def with_keys(papers: DataFrame) -> DataFrame:
    """Titled records with their entity keys; a record without any key stands alone under its position."""
    keys = entity_keys(F.col("doi"), F.col("paper_id"), F.col("title"))
    alone = F.array(F.concat(F.lit("pos:"), F.col("pos").cast("string")))
    return papers.filter(~blank(F.col("title"))).withColumn("keys", F.when(F.size(keys) > 0, keys).otherwise(alone))


def parents(lists: DataFrame, store: Store) -> DataFrame:
    """(node, parent) of key lists (first_pos, keys): the record whose group each joins, itself if none is earlier."""
    ids = store.put(lists.select("first_pos", F.posexplode("keys").alias("i", "key")), "ids")
    # A key of one list connects nothing.
    spread = ids.groupBy("key").agg(F.min("first_pos").alias("holder"), F.max("first_pos").alias("last")).filter("holder < last")
    held = store.put(spread.select("key", "holder"), "holders")
    earlier = lookup(ids, held, "key", store, "hot-keys").filter("holder < first_pos")
    joined = earlier.groupBy("first_pos").agg(F.min_by("holder", "i").alias("parent"))
    return lists.join(joined, "first_pos", "left").select(F.col("first_pos").alias("node"), F.coalesce("parent", "first_pos").alias("parent"))


def assign_groups(papers: DataFrame, mode: str = "ordered") -> DataFrame:
    """Records with ``group_id``, the position of their group's first record.

    ``mode`` "ordered" is the fold; "components" (an extra) takes plain
    connected components over shared keys.
    """
    store = Store(papers.sparkSession, "dedup")
    titled = with_keys(papers)
    keyed = store.put(titled.select("pos", "keys"), "keyed")
    lists = store.put(keyed.groupBy("keys").agg(F.min("pos").alias("first_pos")), "lists")
    if mode == "components":
        ids = lists.select("first_pos", F.explode("keys").alias("key"))
        hubs = ids.groupBy("key").agg(F.min("first_pos").alias("hub"), F.max("first_pos").alias("last")).filter("hub < last").select("key", "hub")
        edges = ids.join(hubs, "key").select(F.col("first_pos").alias("a"), F.col("hub").alias("b"))
        roots = connected_components(edges, store).select(F.col("node").alias("first_pos"), F.col("component").alias("root"))
    else:
        roots = follow(parents(lists, store), store).select(F.col("node").alias("first_pos"), "root")
    groups = lists.join(roots, "first_pos", "left").select("keys", F.coalesce("root", "first_pos").alias("group_id"))
    placed_rows = store.put(keyed.join(groups, "keys").select("pos", "group_id"), "groups")
    return titled.drop("keys").join(placed_rows, "pos")


def merge_groups(grouped: DataFrame, merge_graph_fields: bool = False) -> DataFrame:
    """One record per group: the first record's fields, improved by the others'.

    Longest abstract, most citations and most authors win (the earliest on
    ties); blank pdf_url, doi, venue and year are filled from the earliest
    record that has them; queries and sources unite.  Everything else is the
    first record's.  ``merge_graph_fields`` (an extra) also fills openalex_id and
    referenced_works.
    """
    pos = F.col("pos")

    def earliest(c: str, ok) -> F.Column:
        return F.min_by(F.when(ok, F.col(c)), F.when(ok, pos)).alias(c)

    def longest(c: str, size) -> F.Column:
        return F.max_by(F.col(c), F.struct(F.coalesce(size, F.lit(0)), -pos)).alias(c)

    fills = {"pdf_url": ~blank(F.col("pdf_url")), "doi": ~blank(F.col("doi")), "venue": ~blank(F.col("venue")), "year": F.coalesce(F.col("year"), F.lit(0)) != 0}
    if merge_graph_fields:
        fills |= {"openalex_id": ~blank(F.col("openalex_id")), "referenced_works": F.size(F.coalesce("referenced_works", F.array())) > 0}
    special = {"pos", "group_id", "abstract", "citation_count", "authors", "matched_queries", "source", *fills}
    aggs = [F.min(pos).alias("pos"), F.count(F.lit(1)).alias("n_merged"), longest("abstract", F.length("abstract")), F.max("citation_count").alias("citation_count"), longest("authors", F.size("authors"))]
    aggs += [earliest(c, ok) for c, ok in fills.items()]
    aggs += [F.min_by(c, pos).alias(c) for c in grouped.columns if c not in special]
    base = grouped.groupBy("group_id").agg(*aggs)
    # What the lists need is narrow, and is read from a table of its own.
    grouped = Store(grouped.sparkSession, "merge").put(grouped.select("group_id", "pos", "matched_queries", "source"), "lists")
    # Lists unite over their distinct values, which are few however large the group.
    query = grouped.select("group_id", "pos", F.posexplode("matched_queries").alias("i", "q")).groupBy("group_id", "q").agg(F.min(F.struct("pos", "i")).alias("at"))
    queries = query.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "q"))), lambda s: s["q"]).alias("matched_queries"))
    source = grouped.select("group_id", F.explode(F.split("source", r"\+")).alias("s")).distinct()
    sources = source.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("s")), "+").alias("merged_source"))
    first_source = grouped.groupBy("group_id").agg(F.min_by("source", pos).alias("own_source"))
    out = base.join(queries, "group_id", "left").join(sources, "group_id", "left").join(first_source, "group_id")
    out = out.withColumn("source", F.when(F.col("n_merged") > 1, F.col("merged_source")).otherwise(F.col("own_source")))
    return out.withColumn("matched_queries", F.coalesce("matched_queries", F.array().cast("array<string>"))).drop("merged_source", "own_source")


def dedup_papers(papers: DataFrame, mode: str = "ordered", merge_graph_fields: bool = False) -> DataFrame:
    """Group and merge; columns of ``papers`` in their order."""
    return merge_groups(assign_groups(papers, mode), merge_graph_fields).select(*papers.columns)


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order; rows without a key go."""
    least = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.filter(~blank(F.col(key))).groupBy(F.col(key).alias("_key")).agg(least.alias("r")).select("r.*")


def clean_queries(queries: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(pos, query) without quotes and space runs, 2 to 120 characters, case-insensitively distinct, unseen."""
    q = F.trim(F.regexp_replace(F.regexp_replace(F.col("query"), "[\"'“”]", ""), r"\s+", " "))
    tidy = queries.select("pos", q.alias("query")).filter(F.length("query").between(2, 120)).withColumn("low", F.lower("query"))
    if seen is not None:
        tidy = tidy.join(seen.select(F.lower("query").alias("low")).distinct(), "low", "left_anti")
    return tidy.groupBy("low").agg(F.min(F.struct("pos", "query")).alias("r")).select("r.pos", "r.query")
