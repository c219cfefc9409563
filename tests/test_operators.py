"""Operators on small tables, their traps included."""

import math
import random
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

from citeweave import storage
from citeweave.config import Settings, settings_from_env
from citeweave.operators import audit, dedup, enrich, graph, ranking, record_store, sections, tfidf, topics
from citeweave.schemas import FULLTEXT_STRUCT, PAPERS
from citeweave.sources import cache, payloads, works_source
from citeweave.storage import Store


def papers(spark, rows):
    """Records with the given fields; everything else is absent."""
    full = spark.createDataFrame([], PAPERS).schema
    defaults = {"title": "", "authors": [], "citation_count": 0, "abstract": "", "source": "x", "matched_queries": [], "referenced_works": [], "relevance": 0.0, "score": 0.0, "paper_id": ""}
    return spark.createDataFrame([tuple({**defaults, "pos": i, **r}.get(f.name) for f in full) for i, r in enumerate(rows)], full)


def test_merge_of_two_sources(spark):
    got = dedup.dedup_papers(papers(spark, [
        {"paper_id": "arxiv:2301.00001", "doi": "10.1/x", "title": "One key title here", "pdf_url": "u", "abstract": "short", "source": "arxiv", "matched_queries": ["q1"]},
        {"paper_id": "doi:10.1/x", "doi": "10.1/x", "title": "One key title here", "abstract": "much longer", "citation_count": 120, "venue": "ICML", "source": "openalex", "matched_queries": ["q2", "q1"]},
        {"paper_id": "p3", "title": ""},
    ])).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.paper_id, r.citation_count, r.pdf_url, r.abstract, r.venue, r.source, r.matched_queries) == ("arxiv:2301.00001", 120, "u", "much longer", "ICML", "arxiv+openalex", ["q1", "q2"])


def test_dedup_is_not_transitive(spark):
    rows = [{"paper_id": "a", "doi": "10.1/d1", "title": "First long title"}, {"paper_id": "b", "title": "Second long title"}, {"paper_id": "c", "doi": "10.1/d1", "title": "Second long title"}]
    got = {r.pos: r.group_id for r in dedup.assign_groups(papers(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    assert len({r.group_id for r in dedup.assign_groups(papers(spark, rows), "components").collect()}) == 1


def test_dedup_fold_by_chance(spark):
    rng = random.Random(7)
    rows = [{"paper_id": f"p{i}", "doi": rng.choice([None, f"10.1/{rng.randrange(6)}"]), "title": f"A title of number {rng.randrange(12)}"} for i in range(60)]
    want, claimed = {}, {}
    for i, r in enumerate(rows):
        keys = ([f"doi:{r['doi']}"] if r["doi"] else []) + ["title:" + "".join(ch for ch in r["title"].lower() if ch.isalnum())]
        hit = next((claimed[k] for k in keys if k in claimed), i)
        want[i] = hit
        for k in keys:
            claimed.setdefault(k, hit)
    assert {r.pos: r.group_id for r in dedup.assign_groups(papers(spark, rows)).collect()} == want


def test_singletons_keep_their_source(spark):
    got = dedup.dedup_papers(papers(spark, [{"paper_id": "z", "title": "t", "source": "b+a", "matched_queries": ["q", "q"]}])).first()
    assert got.source == "b+a"


@pytest.mark.parametrize(("scores", "threshold", "keep", "want"), [([0.6, 0.03, 0.4], 0.1, 1, [0, 2]), ([0.02] * 5, 0.5, 2, [0, 1]), ([0.02] * 2, 0.5, 2, []), ([0.1], 0, 5, [0])])
def test_gate(spark, scores, threshold, keep, want):
    pool = papers(spark, [{"paper_id": str(i), "relevance": s} for i, s in enumerate(scores)])
    assert [r.pos for r in ranking.gate(pool, threshold, keep).filter("kept").orderBy("gate_rank").collect()] == want


def test_rank(spark):
    pool = papers(spark, [{"paper_id": "a", "relevance": 0.6, "citation_count": 5, "year": 2023}, {"paper_id": "b", "relevance": 0.1, "citation_count": 100_000}])
    assert [r.paper_id for r in ranking.top_ranked(ranking.rank(pool, 1), 2).collect()] == ["a", "b"]
    assert [r.paper_id for r in ranking.rank(pool, 1, Settings(min_year=2020)).collect()] == ["a"]


def test_expansion(spark):
    docs = [("Deformable mirror control", "A deformable mirror corrects wavefronts with holography"), ("Deformable mirror design", "holography and a deformable mirror")] * 2
    pool = papers(spark, [{"paper_id": str(i), "title": t, "abstract": a, "relevance": 0.6, "score": 1.0} for i, (t, a) in enumerate(docs)])
    found = ranking.expand_queries(pool, "adaptive optics", [])
    assert "deformable mirror" in found and len(found) <= 5
    assert "deformable mirror" not in ranking.expand_queries(pool, "deformable mirror optics", [])
    assert ranking.expand_queries(pool, " ", []) == []


def test_dropped_hubs(spark):
    pool = papers(spark, [{"paper_id": p, "hub_score": h} for p, h in (("keep", 0.9), ("drop1", 0.95), ("drop2", 0.2))])
    assert [r.paper_id for r in ranking.dropped_hubs(pool, pool.filter("paper_id = 'keep'")).collect()] == ["drop1"]


def test_citation_graph(spark):
    refs = {"W1": ["W2", "W3"], "W2": ["W3"], "W3": [], "W4": ["W1"], "W5": ["W1"], "W6": ["W3", "W6", "W99"]}
    pool = papers(spark, [{"paper_id": f"p{w}", "openalex_id": w, "referenced_works": [f"https://x.org/{r}" for r in rs]} for w, rs in refs.items()])
    assert graph.edges_of(pool).count() == 6
    got = {r.openalex_id: r for r in graph.centrality(pool).collect()}
    assert [got[w].hub_score for w in ("W1", "W2", "W3", "W4")] == [0.5598, 0.4453, 1.0, 0.2073]
    assert [got[w].bridge_score for w in ("W1", "W2", "W3", "W4")] == [1.0, 0.0, 0.5714, 0.0]
    exact = {r.node: r.rank for r in graph.pagerank(graph.node_ids(pool), graph.edges_of(pool)).collect()}
    assert abs(exact["W1"] - 0.213096) < 1e-6
    exact = {r.node: r.rank for r in graph.pagerank(graph.node_ids(pool), graph.edges_of(pool), iterations=12).collect()}
    spread = {r.node: r.rank for r in _distributed(graph, pool)}
    assert all(abs(spread[n] - exact[n]) < 1e-12 for n in exact)
    lone = graph.centrality(papers(spark, [{"paper_id": "a"}])).first()
    assert (lone.hub_score, lone.bridge_score) == (0.0, 0.0)


def _distributed(module, pool):
    """PageRank by joins, as larger graphs take it."""
    was, module.LOCAL_EDGES = module.LOCAL_EDGES, -1
    try:
        nodes, edges = module.node_ids(pool), module.edges_of(pool)
        return module.pagerank(nodes, edges, iterations=12).collect()
    finally:
        module.LOCAL_EDGES = was


def test_coupling_gaps(spark):
    refs = spark.createDataFrame([("W20", "W9"), ("W20", "W10"), ("W21", "W9"), ("W21", "W10"), ("W22", "W9")], "paper string, ref string")
    one = graph.coupling_gaps(refs, spark.createDataFrame([("W22",)], "paper string")).collect()
    assert [(r.members, r.uncovered) for r in one] == [(2, 2)]
    assert not graph.coupling_gaps(refs, spark.createDataFrame([("W20",), ("W21",)], "paper string")).collect()
    twice = refs.unionByName(spark.createDataFrame([("W22", "W9")], "paper string, ref string"))
    assert {(r.a, r.b): r.shared for r in graph.coupling_pairs(twice).collect()} == {("W20", "W21"): 2, ("W20", "W22"): 2, ("W21", "W22"): 2}


@pytest.mark.parametrize("min_shared,keyed", [(1, 128), (2, 128), (2, 3), (2, 1), (3, 128)])
def test_coupling_links_connect_what_pairs_connect(spark, min_shared, keyed):
    draw = random.Random(min_shared * 1000 + keyed)
    rows = [(draw.randrange(60), draw.randrange(40) if draw.random() < 0.95 else 0) for _ in range(200)] + [(70, r) for r in range(30)] + [(71, 5), (71, 5), (72, 5)] + [(None, 1), (None, 2), (3, None), (4, None)]
    refs = spark.createDataFrame(rows, "paper long, ref long")
    pairs = [(r.a, r.b) for r in graph.coupling_pairs(refs, min_shared).collect()]
    store = Store(spark, "links")
    links = [(r.a, r.b) for r in graph.coupling_links(refs, store, min_shared, keyed).collect()]
    assert pairs and roots(links) == roots(pairs)


@pytest.mark.parametrize("min_shared,keyed", [(2, 128), (2, 3), (3, 4)])
def test_coupling_pairs_by_definition(spark, min_shared, keyed):
    draw = random.Random(keyed)
    rows = [(draw.randrange(40), draw.randrange(30)) for _ in range(160)] + [(70, r) for r in range(20)] + [(71, r) for r in range(15, 25)] + [(72, 5), (72, 5), (72, 5), (73, 5), (None, 1), (3, None)]
    want = Counter((a, b) for a, r in rows for b, q in rows if None not in (a, b, r, q) and r == q and a < b)
    got = graph.coupling_pairs(spark.createDataFrame(rows, "paper long, ref long"), min_shared, keyed=keyed).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) and {(r.a, r.b): r.shared for r in got} == {k: n for k, n in want.items() if n >= min_shared}


def test_coupling_lists_no_pairs_of_one_reference(spark):
    """Thirty thousand records hold one reference and every two of them another: 450 million pairs share one, 15 000 share two."""
    ids = spark.range(30_000).select(F.col("id").alias("paper"))
    refs = ids.select("paper", F.lit(-1).cast("long").alias("ref")).unionByName(ids.select("paper", F.expr("paper div 2").alias("ref")))
    found = graph.coupling_pairs(refs)
    assert found.agg(F.count(F.lit(1)), F.min("shared"), F.max("shared"), F.min(F.expr("b - a")), F.max(F.expr("b - a"))).first() == (15_000, 2, 2, 1, 1)


def test_coupling_of_a_reference_that_all_records_hold(spark):
    """A hundred thousand records hold one reference; listing their pairs would take five thousand million rows."""
    n = 100_000
    ids = spark.range(n).select(F.col("id").alias("paper"))
    refs = ids.select("paper", F.lit(-1).cast("long").alias("ref")).unionByName(ids.select("paper", F.expr("paper div 2").alias("ref")))
    row = graph.coupled_groups(refs).groupBy("component").count().agg(F.count("*").alias("groups"), F.min("count").alias("least"), F.max("count").alias("most")).first()
    assert (row.groups, row.least, row.most) == (n // 2, 2, 2)


def roots(links):
    """Least reachable node of each linked node."""
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_store(spark, tmp_path):
    store = record_store.RecordStore(spark, f"file://{tmp_path}/pool")
    assert store.read() is None
    first = papers(spark, [{"paper_id": "a", "doi": "10.1/a", "title": "Diffusion models for images", "abstract": "diffusion", "citation_count": 3}, {"paper_id": "b", "title": "Graph networks of words"}])
    store.write(first)
    store.write(papers(spark, [{"paper_id": "a", "doi": "10.1/a", "title": "Diffusion models for images", "abstract": "new", "citation_count": 9}]))
    rows = {r.key: r for r in store.read().collect()}
    assert len(rows) == 2 and rows["doi:10.1/a"].abstract == "new"
    full = record_store.hydrate(papers(spark, [{"paper_id": "x", "doi": "10.1/a", "title": "t"}]), store.read()).first()
    assert (full.abstract, full.citation_count) == ("new", 9)
    docs = store.read().select(F.col("key").alias("doc"), F.concat_ws(" ", "title", "abstract").alias("text"))
    hits = record_store.recall(docs, spark.createDataFrame([(1, "diffusion images")], "query int, text string")).collect()
    assert [h.doc for h in hits] == ["doi:10.1/a"]


@pytest.mark.parametrize(("n", "asked", "want"), [(2, 0, 1), (3, 0, 2), (50, 0, 5), (1000, 0, 8), (100, 3, 3), (4, 99, 3)])
def test_choose_k(n, asked, want):
    assert topics.choose_k(n, asked) == want


def test_two_topics_part(spark):
    words = [("neural image segmentation", "convolution pixels image"), ("protein folding energy", "amino acid protein structure")]
    pool = papers(spark, [{"paper_id": f"{i}", "title": f"{words[i % 2][0]} {i}", "abstract": words[i % 2][1]} for i in range(12)])
    got = {r.pos: r.cluster_id for r in topics.cluster_papers(pool, 2).collect()}
    assert len({got[i] for i in range(0, 12, 2)}) == 1 and len({got[i] for i in range(1, 12, 2)}) == 1 and got[0] != got[1]
    assert {r.cluster_id for r in topics.cluster_papers(pool.filter("pos < 2")).collect()} == {0}


def test_numbering_and_versions(spark):
    members = spark.createDataFrame([("a", 0, 1.0, 0), ("b", 0, 2.0, 1), ("c", 1, 1.0, 2)], "paper_id string, cluster_id int, score double, pos long")
    old = spark.createDataFrame([("a", 7)], "paper_id string, n long")
    assert {r.paper_id: r.n for r in topics.number_citations(members, old).collect()} == {"a": 7, "b": 8, "c": 9}
    cur = spark.createDataFrame([("A", p) for p in ("p1", "p2", "p3", "p4")] + [("B", "n1"), ("B", "n2")], "cluster string, paper_id string")
    prev = spark.createDataFrame([("P", p) for p in ("p1", "p2", "p3", "p4")] + [("Q", "q1")], "cluster string, paper_id string")
    got = {r.cluster: (r.prev, r.kept) for r in topics.match_versions(cur, prev, spark.createDataFrame([("P",)], "cluster string")).collect()}
    assert got == {"A": ("P", True), "B": (None, False)}


def test_sections_and_tables(spark):
    body = "Abstract\nWe study x.\nKeywords: a; b, c.\n1 Introduction\nHello.\n3.1 Setup\nSome setup text.\nTable 1: Scores of runs\nover two seeds\nA  1  2\nB  3  4\nReferences\n[1] x"
    docs = spark.createDataFrame([(1, body), (2, ""), (3, None), (4, "plain"), (5, "Table 2: the end\nmore")], "doc long, text string")
    got = {r.doc: r.fulltext_struct for r in sections.structure(docs).collect()}
    assert [(s.heading, s.level) for s in got[1].sections][:3] == [("Abstract", 1), ("Introduction", 1), ("Setup", 2)]
    assert got[1].keywords == ["a", "b", "c"] and got[1].abstract.startswith("We study x.")
    assert got[1].tables[0].caption.startswith("Table 1") and got[1].tables[0].rows == ["A  1  2", "B  3  4"]
    assert got[2].parse_method == "empty" and got[3].parse_method == "empty" and got[4].sections[0].text == "plain"
    assert got[5].tables[0].rows == []
    parsed = lambda s: spark.range(1).select(F.from_json(F.lit(s), FULLTEXT_STRUCT).alias("s")).select(sections.extract_body(F.col("s"), 120).alias("t")).first().t
    assert len(parsed('{"abstract": "' + "y" * 50 + '", "sections": [{"heading": "2 Methods", "text": "' + "z" * 900 + '"}]}')) <= 200
    assert parsed("{}") is None
    long = parsed('{"abstract": "a", "sections": [{"heading": "Thanks", "text": "no"}, {"heading": "Methods", "text": "m"}, {"heading": "References", "text": "r"}, {"heading": "3 Results", "text": "q"}], "figures": [{"caption": "Fig. 1"}]}')
    assert long == "## 摘要\na\n\n## Methods\nm\n\n## 3 Results\nq\n\n\n## 图表线索\n- 图：Fig. 1"


def test_lines_are_judged_once(spark, capsys):
    """The plan of the result starts from the lines kept, not from the texts."""
    docs = spark.createDataFrame([(1, "Table 1: of runs\nA  1  2\nB  3  4\n\nprose without numbers\n7 of 9 in 11 runs"), (2, None)], "doc long, text string")
    found = sections.detect_tables(docs)
    got = {r.doc: [(t.caption, list(t.rows)) for t in r.tables] for r in found.collect()}
    assert got == {1: [("Table 1: of runs A 1 2", ["B  3  4"]), ("", ["B  3  4"]), ("", ["7 of 9 in 11 runs"])], 2: []}
    capsys.readouterr()
    found.explain()
    assert "posexplode" not in capsys.readouterr().out


def test_parts_follow_the_texts(spark, monkeypatch):
    monkeypatch.setattr(storage, "TASK_BYTES", 100)
    docs = spark.range(50).select(F.col("id").alias("doc"), F.lit("some words of forty characters, no more..").alias("text"))
    n, parts = tfidf.text_parts(docs)
    assert (n, parts) == (50, 21)
    v = tfidf.Vectorizer(ngrams=1, max_features=None)
    assert tfidf.term_counts(docs, v, parts).rdd.getNumPartitions() == tfidf.weights(docs, v).rdd.getNumPartitions() == 21
    seen = []
    store, write = Store(spark, "parts", parts), DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(spark.conf.get(storage.SHUFFLES)), write(self, *a, **k)))
    before = spark.conf.get(storage.SHUFFLES)
    assert store.put(docs.groupBy("text").count(), "t").count() == 1
    assert seen == ["21"] and spark.conf.get(storage.SHUFFLES) == before


@pytest.mark.parametrize("hot,asked", [(1, 1 << 19), (8, 0), (1 << 17, 1 << 19)])
def test_recall_by_definition(spark, monkeypatch, hot, asked):
    """Frequent and rare terms, queries beside the tasks or dealt: each query fitted with all documents."""
    monkeypatch.setattr(record_store, "HOT_TERMS", hot)
    monkeypatch.setattr(record_store, "MOST_ASKED", asked)
    draw, words = random.Random(5), [f"term{i}" for i in range(12)]
    docs = {i: [draw.choice(words) for _ in range(draw.randrange(1, 9))] for i in range(30)}
    queries = {i: [draw.choice([*words, "unknown"]) for _ in range(3)] for i in range(4)}
    want = {}
    for q, ws in queries.items():
        idf = {w: math.log((2 + len(docs)) / (1 + sum(w in d for d in [*docs.values(), ws]))) + 1 for w in [*words, "unknown"]}
        vec = lambda d: {w: n * idf[w] for w, n in Counter(d).items()}  # noqa: E731, B023
        norm = lambda x: math.sqrt(sum(c * c for c in x.values()))
        a = vec(ws)
        scores = {i: sum(a[w] * c for w, c in vec(d).items() if w in a) / norm(a) / norm(vec(d)) for i, d in docs.items()}
        want |= {(q, i): s for i, s in sorted(scores.items(), key=lambda x: (-round(x[1], 12), x[0]))[:5] if s > 0}
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], f"{key} long, text string")
    got = {(r.query, r.doc): r.score for r in record_store.recall(frame(docs, "doc"), frame(queries, "query"), 5).collect()}
    assert len(got) == len(want) and sorted(got.values()) == pytest.approx(sorted(want.values()))
    assert {k: got[k] for k in got if k in want} == pytest.approx({k: want[k] for k in got if k in want})


def test_extract_of_many_sections(spark):
    """Each section is looked at once: a running total taken anew for every section does not end here."""
    body = lambda i: F.struct(F.lit("Methods").alias("heading"), F.lit(1).alias("level"), F.concat(F.lit("text "), i.cast("string")).alias("text"))
    none = F.array().cast("array<struct<caption:string,rows:array<string>>>")
    parsed = F.struct(F.lit("").alias("abstract"), F.col("s").alias("sections"), F.array().cast("array<struct<caption:string>>").alias("figures"), none.alias("tables"))
    one = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), body).alias("s"))
    job = "test_extract_of_many_sections"
    timer = threading.Timer(60, lambda: spark.sparkContext.cancelJobsWithTag(job))
    spark.sparkContext.addJobTag(job)
    timer.start()
    try:
        got = one.select(sections.extract_body(parsed, 100).alias("t")).first().t
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(job)
    assert got == "\n\n".join(f"## Methods\ntext {i}" for i in range(1, 6))


def test_betweenness_by_levels(spark, monkeypatch):
    rng = random.Random(2)
    edges = spark.createDataFrame(sorted({tuple(rng.sample(range(30), 2)) for _ in range(55)}), "src long, dst long")
    nodes = spark.range(32).withColumnRenamed("id", "node")
    held = {r.node: r.between for r in graph.betweenness(nodes, edges).collect()}
    monkeypatch.setattr(graph, "HELD_EDGES", 0)
    levels = {r.node: r.between for r in graph.betweenness(nodes, edges).collect()}
    assert set(held) == set(levels) and max(held.values()) > 0 and all(abs(held[n] - levels[n]) < 1e-9 for n in held)


def test_audit(spark):
    claims = spark.createDataFrame([("s", 0, "t", ["arxiv:1", "2", "zz", "arxiv:1"], "HIGH"), ("s", 1, "u", ["zz"], None)], "section string, claim_ix int, text string, paper_ids array<string>, confidence string")
    cites = spark.createDataFrame([("arxiv:1", 1), ("doi:10.1/b", 2)], "paper_id string, n int")
    got = sorted((r.i, r.paper_id, r.confidence) for r in audit.ground_claims(claims, cites).collect())
    assert got == [(0, "arxiv:1", "high"), (1, "doi:10.1/b", "high")]
    v = audit.faithfulness(spark.createDataFrame([("supported",), ("Unsupported",), ("partial",), (None,), ("unsupp",)], "verdict string")).first()
    assert (v.checked, v.flagged, v.score) == (5, 2, 0.6)
    assert audit.fold_cite_keys(["k", "k", "ka", "k"]) == ["k", "ka", "kaa", "kb"]
    empty = papers(spark, [])
    none = lambda s: spark.createDataFrame([], s)
    dims = {r.dimension: (r.score, r.available) for r in audit.scorecard(audit.ScoreInputs(empty, none("title string, body string"), none("size int"), none("confidence string"), None, 0, 0, 0, 2024)).collect()}
    assert dims["network_hub"] == (60, True) and not any(a for k, (_, a) in dims.items() if k != "network_hub")


def test_cite_keys_beyond_the_alphabet(spark):
    keys = {r.pos: r.key for r in audit.number_entries(spark.range(2500).select(F.col("id").alias("pos"), F.lit("k").alias("base"))).collect()}
    assert keys == {i: "k" + (chr(ord("a") + i - 1) if i else "") for i in range(2500)}
    codes = [1, 127, 128, 2047, 2048, 0xFFFD, 0x10000, 0x10FFFF]
    assert [r.c for r in spark.createDataFrame([(c,) for c in codes], "n int").select(audit.character(F.col("n")).alias("c")).collect()] == [chr(c) for c in codes]


def test_enrichment(spark):
    pool = papers(spark, [{"paper_id": "a", "doi": "10.1/a", "title": "T one"}, {"paper_id": "b", "title": "A title, well"}, {"paper_id": "c", "title": "x", "citation_count": 4}])
    look = spark.createDataFrame([("10.1/a", "zz", 7), ("10.1/b", "A Title well!", 5)], "doi string, title string, citation_count long")
    got = {r.paper_id: (r.citation_count, r.doi) for r in enrich.enrich_citations(pool, look).collect()}
    assert got == {"a": (7, "10.1/a"), "b": (5, "10.1/b"), "c": (4, None)}


def test_payloads(spark):
    work = '{"id":"https://x.org/W5","doi":"https://doi.org/10.1/Z","display_name":"A  work","publication_year":2020,"cited_by_count":3,"abstract_inverted_index":{"b":[1],"a":[0]},"authorships":[{"author":{"display_name":"N M"}}],"referenced_works":["https://x.org/W1"]}'
    paper = '{"paperId":"s1","title":"B","year":2019,"externalIds":{"ArXiv":"2301.1v2"},"authors":[{"name":""},{"name":"Q"}]}'
    item = '{"DOI":"10.2/c","title":["C"],"abstract":"<jats:p>things .</jats:p>","is-referenced-by-count":9,"issued":{"date-parts":[[2018,1]]},"author":[{"given":"G","family":"F"}]}'
    atom = "<entry xmlns='http://www.w3.org/2005/Atom'><id>http://arxiv.org/abs/2301.00001v3</id><title>D</title><published>2023-01-02</published><author><name>X Y</name></author><summary>s</summary></entry>"
    med = "<PubmedArticle><PMID>42</PMID><Article><ArticleTitle>E</ArticleTitle><Abstract><AbstractText>one</AbstractText><AbstractText>two</AbstractText></Abstract><Journal><Title>J</Title></Journal><AuthorList><Author><LastName>L</LastName><ForeName>Fo</ForeName></Author></AuthorList><ELocationID EIdType='doi'>10.3/e</ELocationID><Journal><JournalIssue><PubDate><MedlineDate>2017 Jan</MedlineDate></PubDate></JournalIssue></Journal></Article></PubmedArticle>"
    rows = [("openalex", work), ("semantic_scholar", paper), ("crossref", item), ("arxiv", atom), ("pubmed", med), ("unknown", "{}")]
    df = spark.createDataFrame([(s, "q", p, i) for i, (s, p) in enumerate(rows)], "source string, query string, payload string, pos long")
    got = {r.source: r for r in payloads.fan_out(df, ("openalex", "semantic_scholar", "crossref", "arxiv", "pubmed", "nope")).collect()}
    assert (got["openalex"].paper_id, got["openalex"].title, got["openalex"].abstract, got["openalex"].openalex_id) == ("doi:10.1/z", "A work", "a b", "W5")
    assert (got["semantic_scholar"].paper_id, got["semantic_scholar"].authors, got["semantic_scholar"].pdf_url) == ("arxiv:2301.1", ["", "Q"], "https://arxiv.org/pdf/2301.1")
    assert (got["crossref"].year, got["crossref"].abstract, got["crossref"].citation_count, got["crossref"].authors) == (2018, "things.", 9, ["G F"])
    assert (got["arxiv"].paper_id, got["arxiv"].year, got["arxiv"].venue) == ("arxiv:2301.00001", 2023, "arXiv preprint")
    assert (got["pubmed"].paper_id, got["pubmed"].year, got["pubmed"].abstract, got["pubmed"].authors) == ("doi:10.3/e", 2017, "one two", ["Fo L"])


def test_damaged_and_uneven_xml(spark):
    """What is not well-formed gives a record without a title; names stay with their authors."""
    who = "<Author><Initials>X</Initials><LastName>A</LastName></Author><Author><LastName>B</LastName></Author><Author><ForeName>Cee</ForeName><LastName>C</LastName></Author><Author><CollectiveName>G</CollectiveName></Author>"
    what = "<ELocationID EIdType='pii'>10.9/p</ELocationID><ELocationID EIdType='doi' ValidYN='N'>10.9/n</ELocationID><ELocationID EIdType='doi'>10.9/Y</ELocationID><ArticleDate><Year>soon</Year></ArticleDate>"
    med = f"<PubmedArticle><MedlineCitation><PMID Version='1'>7</PMID><Article><ArticleTitle>One <i>it</i> &lt;two</ArticleTitle><Abstract><AbstractText>a <b>b</b></AbstractText><AbstractText/><AbstractText>c</AbstractText></Abstract><Journal><JournalIssue><PubDate><Year>2011</Year></PubDate></JournalIssue></Journal><AuthorList>{who}</AuthorList>{what}</Article></MedlineCitation><PubmedData><ReferenceList><ArticleIdList><ArticleId IdType='doi'>10.9/ref</ArticleId></ArticleIdList></ReferenceList></PubmedData></PubmedArticle>"
    atom = "<a:entry xmlns:a='http://www.w3.org/2005/Atom'><a:id>http://arxiv.org/abs/cs/0101v2</a:id><a:title>T</a:title><a:author><a:name/></a:author><a:author><a:name>N  M</a:name></a:author><a:link title='pdf' href='http://p'/></a:entry>"
    bad = ["{", "", "<PubmedArticle>", med[:-5], med + "x", med + "<b/>", atom.replace("<a:title>T", "<a:title>T &nbsp;"), "<entry><title>T</title></entry", None, "<other/>"]
    rows = [(s, "q", p, 10 * i + (s == "pubmed")) for i, p in enumerate([med, atom, *bad]) for s in ("arxiv", "pubmed")]
    links = spark.createDataFrame([("7", "u7"), ("7", "v7"), ("8", "u8")], "pmid string, pdf_url string")
    got = {r.pos: r for r in payloads.fan_out(spark.createDataFrame(rows, "source string, query string, payload string, pos long"), ("arxiv", "pubmed"), links).collect()}
    assert len(got) == len(rows) and all(got[p].title == "" for p in got if p not in (1, 10))
    assert all((got[p].venue, got[p].authors, got[p].doi, got[p].paper_id) == ("", [], None, "") for p in got if p >= 20 and p < 20 + 10 * (len(bad) - 1))
    m, a = got[1], got[10]
    assert (m.paper_id, m.title, m.abstract, m.authors, m.year, m.doi, m.pdf_url, m.url) == ("doi:10.9/y", "One it <two", "a b c", ["X A", "B", "Cee C"], 2011, "10.9/y", "u7", "https://pubmed.ncbi.nlm.nih.gov/7/")
    assert (a.paper_id, a.authors, a.pdf_url, a.venue, a.year) == ("arxiv:cs/0101", ["N M"], "http://p", "arXiv preprint", None)


def test_works_source_answers_predicates(spark, tmp_path):
    """The reader takes the year, kind and access predicates; Spark repeats none of them, and keeps the others."""
    rows = [
        '{"id":"W1","type":"article","publication_year":2020,"open_access":{"is_oa":true}}', '{"id":"W2","type":"article","publication_year":2019,"open_access":{"is_oa":true}}', "{torn", "[1]", "",
        '{"id":"W3","type":"dataset","publication_year":2021,"open_access":{"is_oa":true}}', '{"id":"W4","type":"preprint","publication_year":2022,"open_access":{"is_oa":false}}',
        '{"id":"W5","type":"preprint","publication_year":"2022","open_access":[]}', '{"id":"W6","type":"preprint","publication_year":2023,"open_access":{"is_oa":true}}', '{"id":7,"type":"article","publication_year":2024,"open_access":{"is_oa":true}}',
    ]
    for i in range(0, len(rows), 4):
        (tmp_path / f"page-{i}.json").write_text("\n".join(rows[i : i + 4]))
    (tmp_path / "_SUCCESS").write_text("")
    path = f"file://{tmp_path}"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = works_source.search_works(spark, path, 2020, True)
    assert sorted(str(r.id) for r in found.collect()) == ["None", "W1", "W6"] and "Filter (" not in plan(found)
    assert found.rdd.getNumPartitions() == 3
    other = found.filter("id like '%6' or id = 'W1'").filter("publication_year in (2020, 2024) or is_oa is null")
    assert [r.id for r in other.collect()] == ["W1"] and "Filter (" in plan(other)
    assert sorted(r.id for r in works_source.works(spark, path, "id string").collect() if r.id) == ["W1", "W2", "W3", "W4", "W5", "W6"]
    assert not works_source.works(spark, f"{path}/none").collect()
    reader = works_source.WorksReader(None, path)
    asked = [EqualTo(("is_oa",), True), GreaterThan(("publication_year",), 2019), IsNotNull(("is_oa",)), EqualTo(("id",), "W1")]
    assert list(reader.pushFilters(asked)) == asked[3:] and len(reader.asked) == 3
    assert [works_source.page_size(n) for n in (0, 25, 900)] == [1, 25, 200]


def test_cache_and_retries(tmp_path):
    now = [0.0]
    store = cache.ResponseCache(str(tmp_path), 1, lambda: now[0])
    key = cache.cache_key("s", "u", {"b": 1, "a": 2})
    assert key == cache.cache_key("s", "u", {"a": 2, "b": 1}) and len(key) == 32
    assert cache.fetch(lambda: (200, "x"), store, key) == "x" and cache.fetch(lambda: (500, ""), store, key) == "x"
    now[0] = 2 * 86_400
    waits = []
    replies = iter([(429, ""), (429, ""), (200, "y")])
    assert cache.fetch(lambda: next(replies), store, key, sleep=waits.append) == "y" and waits == [3, 6]
    assert cache.fetch(lambda: (404, "no"), store, "other") is None and store.get("other") is None
    assert cache.transient("HTTP 503") and cache.transient(ConnectionError("Connection reset by peer")) and not cache.transient("bad request 400")
    t = [0.0]
    limiter = cache.RateLimiter(1.0, lambda: t[0], lambda s: t.__setitem__(0, t[0] + s))
    limiter.wait(), limiter.wait()
    assert t[0] == 1.0


def test_settings():
    s = settings_from_env("X_", {"X_POOL_CAP": "7", "X_GATE_THRESHOLD": "bad", "X_SOURCES": "a, b", "X_INCREMENTAL": "yes"})
    assert (s.pool_cap, s.gate_threshold, s.sources, s.incremental) == (7, 0.10, ("a", "b"), True)


def test_registered_kmeans_takes_all_restarts(spark, monkeypatch):
    from citeweave.plans.queries import REGISTRY

    seen, real = [], topics.kmeans
    monkeypatch.setattr(topics, "kmeans", lambda v, k, restarts=topics.RESTARTS: seen.append(restarts) or real(v, k, 1))
    assert REGISTRY["topic_kmeans"](spark, "/root/testdata/sf0.001").count() > 0 and seen == [10]


def plain_silhouettes(points, labels):
    """By definition, from all differences."""
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(2))
    out = []
    for i, own in enumerate(labels):
        same = [d[i, j] for j, c in enumerate(labels) if c == own and j != i]
        others = [np.mean([d[i, j] for j, c in enumerate(labels) if c == k]) for k in set(labels) - {own}]
        if not same or not others or max(np.mean(same), min(others)) == 0:
            out.append(0.0)
        else:
            out.append((min(others) - np.mean(same)) / max(np.mean(same), min(others)))
    return out


def test_silhouettes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topics, "BLOCK_ROWS", 20)
    monkeypatch.setattr(topics, "STRIP_ROWS", 7)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(90, 5)) + 3 * (np.arange(90) % 3)[:, None]
    points[60:75] = points[0]  # copies
    points[75] = 0.0
    one = [int(n % 3) for n in range(90)]
    two = [4 if n == 17 else int(n > 40) for n in range(90)]  # a cluster of one, numbers without records
    rows = spark.createDataFrame([(n, points[n].tolist(), one[n], two[n], 0) for n in range(90)], "doc long, v array<double>, a int, b int, c int")
    got = topics.silhouettes(rows, {"a": 3, "b": 5, "c": 1}).orderBy("doc").collect()
    assert np.allclose([r.a for r in got], plain_silhouettes(points, one), atol=1e-9)
    assert np.allclose([r.b for r in got], plain_silhouettes(points, two), atol=1e-9)
    assert {r.c for r in got} == {0.0}
    clusters = rows.select("doc", F.col("a").alias("cluster"))
    assert abs(topics.silhouette(rows.select("doc", "v"), clusters) - np.mean(plain_silhouettes(points, one))) < 1e-9
    copies = rows.filter("doc BETWEEN 60 AND 74")
    assert {r.b for r in topics.silhouettes(copies.withColumn("b", F.col("doc").cast("int") % 2), {"b": 2}).collect()} == {0.0}
    assert topics.silhouettes(rows.filter("doc < 0"), {"a": 3}).count() == 0


def test_best_k_beyond_two_thousand_records(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(n, (rng.normal(scale=0.2, size=3) + 5 * np.eye(3)[n % 3]).tolist()) for n in range(2100)], "doc long, v array<double>")
    assert topics.best_k(rows, 4) == 3
    assert topics.best_k(rows, 1) == 2
