"""Citation graph operators: edges, PageRank, betweenness, coupling gaps, export."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identifiers import last_segment
from ..functions.text import filled
from ..storage import Store
from .components import connected_components
from .joins import lookup

DAMPING, ITERATIONS = 0.85, 60
#: Rounds of PageRank whose tables are dropped together.
DROP_EVERY = 10
#: Graphs of at most this many edges are ranked in one task, where a round costs no shuffle.
LOCAL_EDGES = 200_000
#: Betweenness holds graphs of at most this many edges beside each task; larger ones are walked level by level with joins.
HELD_EDGES = 2_000_000
#: Records of at most this many references that others hold too are coupled by keys of two references, larger ones by counting.
KEYED_REFERENCES = 128
#: References whose records' keys one task sorts.
REFERENCES_PER_TASK = 500_000


def node_ids(papers: DataFrame) -> DataFrame:
    """(node, pos, paper_id): the graph id of each record; of equal ids the last record counts."""
    node = F.coalesce(filled(F.col("openalex_id")), F.col("paper_id"))
    rows = papers.select(node.alias("node"), "pos", "paper_id")
    return rows.groupBy("node").agg(F.max("pos").alias("pos"), F.max_by("paper_id", "pos").alias("paper_id"))


def edges_of(papers: DataFrame) -> DataFrame:
    """Distinct (src, dst) references between records of the pool, without loops; references match raw or by last segment."""
    nodes = node_ids(papers)
    own = F.coalesce(filled(F.col("openalex_id")), F.col("paper_id"))
    refs = papers.select("pos", own.alias("src"), F.explode("referenced_works").alias("ref")).join(nodes.select(F.col("node").alias("src"), F.col("pos").alias("_last")), "src").filter("pos = _last")
    raw = refs.join(nodes.select(F.col("node").alias("ref"), F.col("node").alias("dst")), "ref", "left")
    short = raw.withColumn("ref2", last_segment(F.col("ref"))).join(nodes.select(F.col("node").alias("ref2"), F.col("node").alias("dst2")), "ref2", "left")
    return short.select("src", F.coalesce("dst", "dst2").alias("dst")).filter("dst is not null and src <> dst").distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(node, rank) after exactly ``iterations`` rounds from a uniform start; dangling mass is spread evenly."""
    store = Store(nodes.sparkSession, "pagerank")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    base = store.put(nodes.select("node").join(degree, nodes.node == degree.src, "left").select("node", F.coalesce("out", F.lit(0)).alias("out")), "nodes")
    links = store.put(edges.join(degree, "src"), "links")
    n = base.count()
    if n <= LOCAL_EDGES and links.count() <= LOCAL_EDGES:
        return _local_pagerank(base, links, damping, iterations)
    ranks = base.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(iterations):
        # Every round is a table, so the plan of a round does not hold those before it.
        loose = ranks.filter("out = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = F.lit((1 - damping) / max(n, 1) + damping * loose / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))
        ranks = store.put(base.join(given, "node", "left").select("node", "out", new.alias("rank")), f"ranks{i}")
        if i % DROP_EVERY == DROP_EVERY - 1:
            store.drop(*(f"ranks{j}" for j in range(i - DROP_EVERY, i)))
    return ranks.select("node", "rank")


def _local_pagerank(base: DataFrame, links: DataFrame, damping: float, iterations: int) -> DataFrame:
    """The same rounds over arrays, in one task; nodes and links are bounded by LOCAL_EDGES."""
    kind = dict(base.dtypes)["node"]
    sides = base.select(F.col("node").alias("a"), F.lit(None).cast(kind).alias("b"), "out").unionByName(links.select(F.col("src").alias("a"), F.col("dst").alias("b"), "out"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["b"].isna()].sort_values("a").reset_index(drop=True)
        edges = pdf[pdf["b"].notna()]
        place = {v: i for i, v in enumerate(nodes["a"])}
        src = np.array([place[v] for v in edges["a"]], np.int64)
        dst = np.array([place[v] for v in edges["b"]], np.int64)
        out = nodes["out"].to_numpy(np.float64)
        n = len(nodes)
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            got = np.bincount(dst, weights=rank[src] / out[src], minlength=n)
            rank = (1 - damping) / n + damping * (got + rank[out == 0].sum() / n)
        return pd.DataFrame({"node": nodes["a"].astype(base_kind), "rank": rank})

    base_kind = "object" if kind == "string" else "int64"
    return sides.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, f"node {kind}, rank double")


def scaled(scores: DataFrame, column: str, has_edges: bool, name: str) -> DataFrame:
    """(node, name): a score over its maximum, rounded to 4 places; zero without edges."""
    if not has_edges:
        return scores.select("node", F.lit(0.0).alias(name))
    top = scores.agg(F.max(column).alias("_top"))
    return scores.crossJoin(F.broadcast(top)).select("node", F.when(F.col("_top") > 0, F.round(F.col(column) / F.col("_top"), 4)).otherwise(0.0).alias(name))


def _brandes(adjacent: dict[str, list[str]], source: str) -> dict[str, float]:
    """Dependencies of all nodes on one source, by shortest-path counting."""
    depth, paths, order = {source: 0}, {source: 1.0}, [source]
    for v in order:
        for w in adjacent.get(v, ()):
            if w not in depth:
                depth[w] = depth[v] + 1
                paths[w] = 0.0
                order.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] += paths[v]
    share = dict.fromkeys(order, 0.0)
    for w in reversed(order):
        for v in adjacent.get(w, ()):
            if depth[v] == depth[w] - 1:
                share[v] += paths[v] / paths[w] * (1 + share[w])
    share.pop(source)
    return share


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, between) of the undirected graph, each pair once; sources are spread over tasks."""
    both = Store(nodes.sparkSession, "between").put(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst").distinct(), "both")
    if both.count() > HELD_EDGES:
        summed = _levels(nodes, both)
    else:
        summed = _held(nodes, both)
    return nodes.select("node").join(summed, "node", "left").select("node", F.coalesce("x", F.lit(0.0)).alias("between"))


def _held(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """(node, x) with the graph, of at most HELD_EDGES edges, as numbered arrays beside each task."""
    kind = dict(nodes.dtypes)["node"]
    adjacent: dict = {}
    for r in both.collect():  # at most HELD_EDGES rows
        adjacent.setdefault(r.src, []).append(r.dst)
    shared = nodes.sparkSession.sparkContext.broadcast(adjacent)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            total: dict = {}
            for source in pdf["node"]:
                for v, x in _brandes(shared.value, source).items():
                    total[v] = total.get(v, 0.0) + x
            yield pd.DataFrame({"node": list(total), "x": list(total.values())})

    return nodes.select("node").mapInPandas(run, f"node {kind}, x double").groupBy("node").agg((F.sum("x") / 2).alias("x"))


def _levels(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """(node, x) by joins: all sources advance level by level, then dependencies flow back from the last level.

    A level is a table (s, v, paths) of the nodes v first met there and the
    number of shortest paths from s.
    """
    store = Store(nodes.sparkSession, "levels")
    levels = [store.put(nodes.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")), "level0")]
    while True:
        ahead = levels[-1].join(both, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        # A neighbour is in the level before, in the same one, or new.
        for known in levels[-2:]:
            ahead = ahead.join(known.select("s", "v"), ["s", "v"], "left_anti")
        reached = store.put(ahead, f"level{len(levels)}")
        if not reached.head(1):
            break
        levels.append(reached)
    shares = []
    share = None
    for depth in range(len(levels) - 1, 0, -1):
        here = levels[depth]
        here = here.withColumn("share", F.lit(0.0)) if share is None else here.join(share, ["s", "v"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        here = store.put(here, f"back{depth}")
        shares.append(here.select(F.col("v").alias("node"), "share"))
        above = levels[depth - 1].select("s", F.col("v").alias("u"), F.col("paths").alias("before"))
        steps = here.join(both.select(F.col("src").alias("v"), F.col("dst").alias("u")), "v").join(above, ["s", "u"])
        share = steps.groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("before") / F.col("paths") * (1 + F.col("share"))).alias("share"))
    if not shares:
        return nodes.select("node", F.lit(0.0).alias("x")).limit(0)
    out = shares[0]
    for part in shares[1:]:
        out = out.unionByName(part)
    return out.groupBy("node").agg((F.sum("share") / 2).alias("x"))


def centrality(papers: DataFrame) -> DataFrame:
    """Papers with hub_score (PageRank) and bridge_score (betweenness), each over its maximum."""
    edges, nodes = edges_of(papers), node_ids(papers)
    some = bool(edges.head(1))
    hub = scaled(pagerank(nodes, edges), "rank", some, "hub_score") if some else scaled(nodes, "pos", False, "hub_score")
    bridge = scaled(betweenness(nodes, edges), "between", some, "bridge_score") if some else scaled(nodes, "pos", False, "bridge_score")
    node = F.coalesce(filled(F.col("openalex_id")), F.col("paper_id"))
    return papers.drop("hub_score", "bridge_score").withColumn("node", node).join(hub, "node", "left").join(bridge, "node", "left").drop("node")


def _store(references: DataFrame, rows: int | None) -> Store:
    """Tables whose shuffles have parts of REFERENCES_PER_TASK references; ``rows`` bounds their number and is counted if not given."""
    rows = references.count() if rows is None else rows
    return Store(references.sparkSession, "coupling", -(-rows // REFERENCES_PER_TASK))


def _reference_keys(lists: DataFrame) -> DataFrame:
    """(paper, one, two): each two of a record's ``refs``, structs or values in ascending order."""
    one = lists.select("paper", "refs", F.posexplode("refs").alias("i", "one"))
    return one.select("paper", "one", F.explode(F.slice("refs", F.col("i") + 2, F.size("refs") - F.col("i") - 1)).alias("two"))


def coupling_pairs(references: DataFrame, min_shared: int = 2, rows: int | None = None, keyed: int = KEYED_REFERENCES) -> DataFrame:
    """(a, b, shared) of records that share references (paper, ref); repeated references count each time.

    Records that share s references share s (s - 1) / 2 keys of two, so only
    records that share at least two ever meet, however many hold one of their
    references.  A reference held x times by a record and y times by another
    counts x y; summed over the keys each counts s - 1 times.  Pairs that share
    one repeated reference only, and those with records of more than ``keyed``
    references, are counted by their references.
    """
    if min_shared < 2:
        left, right = references.select("ref", F.col("paper").alias("a")), references.select("ref", F.col("paper").alias("b"))
        return left.join(right, "ref").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)
    store = _store(references, rows)
    held = store.put(references.select("paper", "ref").dropna().groupBy("paper", "ref").agg(F.count(F.lit(1)).alias("times")), "held")
    lists = held.groupBy("paper").agg(F.count(F.lit(1)).alias("n"))
    large = store.put(lists.filter(F.col("n") > keyed).select("paper"), "large")
    small = held.join(large, "paper", "left_anti") if large.head(1) else held
    keys = _reference_keys(small.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("ref", "times"))).alias("refs")))  # at most ``keyed``
    keys = store.put(keys.select("paper", F.col("one.ref").alias("r1"), F.col("two.ref").alias("r2"), F.col("one.times").alias("t1"), F.col("two.times").alias("t2")), "keys")
    left, right = (keys.select("r1", "r2", F.col("paper").alias(p), F.col("t1").alias(f"{p}1"), F.col("t2").alias(f"{p}2")) for p in "ab")
    met = left.join(right, ["r1", "r2"]).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m"), F.sum(F.expr("a1 * b1 + a2 * b2")).alias("x"))
    # m = s (s - 1) / 2, so s - 1 = (sqrt(8 m + 1) - 1) / 2.
    pairs = met.select("a", "b", F.round(F.col("x") / ((F.sqrt(8.0 * F.col("m") + 1) - 1) / 2)).cast("long").alias("shared"))
    one, other = held.select("ref", F.col("paper").alias("p"), F.col("times").alias("x")), held.select("ref", F.col("paper").alias("q"), F.col("times").alias("y"))
    ends = (F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    if held.filter("times > 1").head(1):
        pairs = store.put(pairs, "keyed")
        twice = one.filter("x > 1").join(other, "ref").filter("p <> q").select(*ends, (F.col("x") * F.col("y")).alias("shared")).distinct()
        if large.head(1):
            twice = twice.join(large.withColumnRenamed("paper", "a"), "a", "left_anti").join(large.withColumnRenamed("paper", "b"), "b", "left_anti")
        pairs = pairs.unionByName(twice.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if large.head(1):
        big = one.join(large.withColumnRenamed("paper", "p"), "p").join(other, "ref").filter("p <> q")
        # Of two large records each meets the other.
        met = big.groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("shared"))
        pairs = pairs.unionByName(met.select(*ends, "shared").distinct())
    return store.put(pairs.filter(F.col("shared") >= min_shared), "pairs")


def coupling_links(references: DataFrame, store: Store, min_shared: int = 2, keyed: int = KEYED_REFERENCES) -> DataFrame:
    """(a, b): links that connect the same groups as the pairs of :func:`coupling_pairs` do, without listing those pairs.

    Records that share two references share a *key* of two references, and each
    links to its key's least holder: a reference that very many records hold
    costs each of them a few keys, and no pair.  Records of more than ``keyed``
    references, of which there are few, are counted against the holders of
    their references instead.  A reference that some record holds twice
    couples all its holders to that one.  Above two shared references the pairs
    themselves are the links.  Null records and references couple nothing.
    """
    if min_shared > 2:
        return coupling_pairs(references, min_shared).select("a", "b")
    held = store.put(references.select("paper", "ref").dropna().groupBy("ref", "paper").agg(F.count(F.lit(1)).alias("times")), "held")
    # A reference of one record couples nothing.
    holders = held.groupBy("ref").agg(F.min("paper").alias("least"), F.max("paper").alias("last"), F.min(F.when(F.col("times") > 1, F.col("paper"))).alias("twice")).filter("least < last")
    shared = store.put(lookup(held, store.put(holders.drop("last"), "holders"), "ref", store, "hot-references"), "shared")
    alone = shared.select(F.col("paper").alias("a"), F.col("least" if min_shared < 2 else "twice").alias("b")).filter("a <> b")
    if min_shared < 2:
        return alone
    sizes = store.put(shared.groupBy("paper").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    sized = store.put(lookup(shared.select("paper", "ref"), sizes, "paper", store, "hot-records"), "sized")
    lists = sized.filter(F.col("n") <= keyed).groupBy("paper").agg(F.array_sort(F.collect_list("ref")).alias("refs"))  # at most ``keyed``
    keys = store.put(_reference_keys(lists).select("paper", F.struct(F.col("one").alias("r1"), F.col("two").alias("r2")).alias("key")), "keys")
    leads = keys.groupBy("key").agg(F.min("paper").alias("lead"), F.max("paper").alias("last")).filter("lead < last").select("key", "lead")
    by_key = lookup(keys, store.put(leads, "leads"), "key", store, "hot-keys").select(F.col("paper").alias("a"), F.col("lead").alias("b")).filter("a <> b")
    large = sized.filter(F.col("n") > keyed).select("ref", F.col("paper").alias("a"))
    counted = large.join(sized.select("ref", F.col("paper").alias("b")), "ref").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    return alone.unionByName(by_key).unionByName(counted)


def coupled_groups(references: DataFrame, min_shared: int = 2, rows: int | None = None) -> DataFrame:
    """(node, component) of all records that share at least ``min_shared`` references with another one."""
    store = _store(references, rows)
    return connected_components(coupling_links(references, store, min_shared), store)


def coupling_gaps(references: DataFrame, covered: DataFrame, min_shared: int = 2, rows: int | None = None) -> DataFrame:
    """(component, members, uncovered): strongly coupled groups with at least two records outside all clusters."""
    members = coupled_groups(references, min_shared, rows)
    out = members.join(covered.select(F.col("paper").alias("node")).distinct().withColumn("inside", F.lit(1)), "node", "left")
    groups = out.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("inside").isNull(), 1)).alias("uncovered"))
    return groups.filter("members >= 2 and uncovered >= 2")


def gap_sentences(references: DataFrame, papers: DataFrame, covered: DataFrame, min_shared: int = 2) -> DataFrame:
    """(component, sentence) naming the first three uncovered records by position."""
    members = coupled_groups(references, min_shared)
    outside = members.join(covered.select(F.col("paper").alias("node")).distinct(), "node", "left_anti").join(papers.select(F.col("paper_id").alias("node"), "pos", "title"), "node")
    order = Window.partitionBy("component").orderBy("pos")
    first = outside.withColumn("i", F.row_number().over(order)).filter("i <= 3").groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "title"))), lambda s: s["title"]), "、").alias("names"))
    count = outside.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    text = F.concat(F.lit("共引子群（"), F.col("n").cast("string"), F.lit(" 篇）未被现有主题覆盖，可能构成研究空白："), F.col("names"), F.when(F.col("n") > 3, F.lit(" 等")).otherwise(""))
    return count.join(first, "component").select("component", text.alias("sentence"))


def graph_stats(nodes: DataFrame, edges: DataFrame, scores: DataFrame, top: int = 5) -> DataFrame:
    """One row: node and edge counts and the best nodes by score above zero, as text."""
    best = scores.filter("score > 0").orderBy(F.col("score").desc(), "node").limit(top)
    names = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node"))), lambda s: s["node"].cast("string")), ",").alias("top_nodes"))
    return nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edge_count"))).crossJoin(names)


def best_nodes(papers: DataFrame, score: str, top: int = 5) -> DataFrame:
    """One row with the first ``top`` records by a score above zero, stable in position: id, label and score."""
    best = papers.filter(F.col(score) > 0).orderBy(F.col(score).desc(), "pos").limit(top)
    entry = F.struct((-F.col(score)).alias("s"), "pos", F.struct(F.col("paper_id").alias("id"), F.trim(F.coalesce("title", F.lit(""))).alias("label"), F.round(score, 4).alias("score")).alias("e"))
    return best.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias(f"top_{score}"))  # at most top rows


def export_graph(papers: DataFrame, edges: DataFrame, clusters: DataFrame, gaps: list[str]) -> DataFrame:
    """One row with the graph as a JSON document: nodes, edges, gaps and statistics with the five best by either score."""
    label = clusters.select(F.explode("paper_ids").alias("paper_id"), "label", "cluster_id").groupBy("paper_id").agg(F.max_by("label", "cluster_id").alias("cluster"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = papers.withColumn("hub_score", zero("hub_score").cast("double")).withColumn("bridge_score", zero("bridge_score").cast("double"))
    node = known.join(label, "paper_id", "left").select("pos", F.struct(F.col("paper_id").alias("id"), F.trim(F.coalesce("title", F.lit(""))).alias("label"), zero("year").alias("year"), zero("citation_count").alias("citations"), F.round("hub_score", 4).alias("hub"), F.round("bridge_score", 4).alias("bridge"), F.coalesce("cluster", F.lit("")).alias("cluster")).alias("n"))
    nodes = node.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "n"))), lambda s: s["n"]).alias("nodes"))
    links = edges.agg(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst"))), lambda e: F.array(e["src"], e["dst"])).alias("edges"))
    rename = lambda c, name: F.transform(c, lambda e: F.struct(e["id"].alias("id"), e["label"].alias("label"), e["score"].alias(name)))
    stats = F.struct(F.size("nodes").alias("node_count"), F.size("edges").alias("edge_count"), rename("top_hub_score", "hub").alias("top_hub"), rename("top_bridge_score", "bridge").alias("top_bridge"))
    doc = F.struct("nodes", "edges", F.array(*(F.lit(g) for g in gaps)).cast("array<string>").alias("gaps"), stats.alias("stats"))
    return nodes.crossJoin(links).crossJoin(best_nodes(known, "hub_score")).crossJoin(best_nodes(known, "bridge_score")).select(F.to_json(doc).alias("graph"))


def neighbourhood(edges: DataFrame, node: str, limit: int = 8) -> DataFrame:
    """(direction, node): at most ``limit`` neighbours on either side."""
    out = edges.filter(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("node")).orderBy("node").limit(limit)
    into = edges.filter(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("node")).orderBy("node").limit(limit)
    return out.unionByName(into)
