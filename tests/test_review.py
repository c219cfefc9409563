"""The whole pipeline with the offline model, and streaming ingest."""

import json
import re

from citeweave.config import Settings
from citeweave.plans.model import OfflineModel, ask_many
from citeweave.operators.record_store import RecordStore
from citeweave.plans.review import Review, ReviewState, since_year
from citeweave.streaming.ingest import start_ingest
from test_operators import papers


def pool(spark):
    words = [("neural image segmentation", "convolution pixels image"), ("protein folding energy", "amino acid protein structure")]
    return papers(spark, [{"paper_id": f"p{i}", "openalex_id": f"W{i}", "title": f"{words[i % 2][0]} part {i} of many", "abstract": f"{words[i % 2][1]} number {i}", "year": 2010 + i, "citation_count": i, "matched_queries": ["q"], "referenced_works": [f"W{(i + 2) % 24}", f"W{(i + 4) % 24}"]} for i in range(24)])


def test_end_to_end(spark):
    run = Review(spark, lambda queries, settings: pool(spark), Settings(pool_target=20, clusters=2, gate_threshold=0.0, expand_enabled=False))
    state = run.run("image segmentation")
    assert state.errors == []
    assert len(state.clusters) == 2 and sum(c["size"] for c in state.clusters) == 24
    assert sorted(state.citations.values()) == list(range(1, 25))
    report = state.outputs["review.md"]
    body, refs = report.split("## 参考文献")
    assert {int(n) for n in re.findall(r"\[(\d+)\]", body)} <= {int(n) for n in re.findall(r"\*\*\[(\d+)\]\*\*", refs)}
    assert state.faithfulness["score"] == 1.0 and json.loads(state.outputs["quality_report.json"])["grade"] in "ABCD"
    assert state.outputs["references.bib"].count("@") == 24 and json.loads(state.outputs["citation_graph.json"])["stats"]["edge_count"] == 48
    assert run.resume(state, "ok")


def test_recall_and_window(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    assert RecordStore(spark, root).recall(["protein"], 3) is None
    RecordStore(spark, root).write(pool(spark))
    best = RecordStore(spark, root).recall(["protein energy", "protein", "protein"], 3).orderBy("pos").collect()
    assert [r.pos for r in best] == list(range(len(best))) and 3 <= len(best) <= 6
    assert len({r.paper_id for r in best}) == len(best) and all("protein" in r.title for r in best)

    found = papers(spark, [{"paper_id": f"n{y}", "title": f"Fresh finding of {y}", "abstract": "x", "year": y} for y in (2019, 2021, 2022)] + [{"paper_id": "n0", "title": "Undated finding", "abstract": "x"}])
    run = Review(spark, lambda queries, settings: found, Settings(incremental=True, recall_top_k=2), store_root=root)
    state = ReviewState("image segmentation", since_date="2021-06-30", queries=["image segmentation"])
    run.retrieve(state)
    ids = [r.paper_id for r in state.papers.orderBy("pos").collect()]
    assert ids[-2:] == ["n2021", "n2022"] and len(ids) == 4  # two of the store come first, older and undated ones go
    run.retrieve(state)
    assert state.papers.count() == 4


def test_since_year():
    from datetime import date

    assert since_year("2023-01-01", 180) == 2023 and since_year(None, 180, date(2024, 3, 1)) == 2023
    assert since_year("n/a", 10, date(2024, 3, 1)) == 2024


def test_guard_and_deadline(spark):
    def broken(queries, settings):
        raise RuntimeError("no source")

    late = iter(range(0, 10_000, 100))
    state = Review(spark, broken, Settings(watchdog_seconds=150), clock=lambda: next(late)).run("x")
    assert [e["node"] for e in state.errors][:1] == ["retrieve"] and state.errors[0]["kind"] == "RuntimeError"


def test_ask_many_keeps_order_and_defaults():
    def call(i):
        if i == 2:
            raise ValueError
        return i * i

    assert ask_many(call, range(5), default=-1) == [0, 1, -1, 9, 16]
    assert OfflineModel().generate("unknown", {}) == "{}"


def test_state_defaults():
    assert ReviewState("t").queries == [] and ReviewState("t").verdict == "pass"


def test_streaming_ingest(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    item = {"DOI": "10.2/c", "title": ["A crossref title"], "is-referenced-by-count": 9}
    (inbox / "a.json").write_text(json.dumps({"source": "crossref", "query": "q", "payload": json.dumps(item), "pos": 0}) + "\n")
    for _ in range(2):
        start_ingest(spark, f"file://{inbox}", f"file://{tmp_path}/pool", f"file://{tmp_path}/cp", once=True).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/pool/v1").collect()
    assert [(r.key, r.citation_count) for r in got] == [("doi:10.2/c", 9)]
