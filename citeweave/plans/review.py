"""The review pipeline: a driver loop over DataFrame stages, with guards, routes and a deadline.

The driver holds scalars and short lists (at most the pool's cap of records);
every stage over records is a DataFrame plan, written to a table so that the
guard sees its errors.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import bibliography
from ..operators import audit, dedup, graph, ranking, topics
from ..operators.record_store import RecordStore, hydrate
from ..storage import Store
from .model import OfflineModel, TextModel, ask, ask_many

Search = Callable[[list[str], Settings], DataFrame]
_MARK = re.compile(r"\[(\d{1,3})\]")


class Interrupt(Exception):
    """Raised by a stage that waits for a person; never swallowed by the guard."""


@dataclass
class ReviewState:
    """What the stages share; the append-only lists are never rewritten."""

    topic: str
    since_date: str | None = None
    queries: list[str] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)
    papers: DataFrame | None = None
    retrieval_round: int = 0
    critic_round: int = 0
    expanded: bool = False
    evidence: dict[str, dict] = field(default_factory=dict)
    clusters: list[dict] = field(default_factory=list)
    citations: dict[str, int] = field(default_factory=dict)
    previous_clusters: dict[str, list[str]] = field(default_factory=dict)
    sections: dict[str, str] = field(default_factory=dict)
    kept_sections: set[str] = field(default_factory=set)
    claims: list[dict] = field(default_factory=list)
    faithfulness: dict[str, Any] = field(default_factory=dict)
    gaps: list[str] = field(default_factory=list)
    gate: dict[str, Any] = field(default_factory=dict)
    edge_count: int = 0
    dropped_hubs: list[str] = field(default_factory=list)
    verdict: str = "pass"
    errors: list[dict] = field(default_factory=list)
    outputs: dict[str, str] = field(default_factory=dict)


def strip_marks(text: str, allowed: set[int]) -> str:
    """Text without marks whose number is not allowed."""
    return _MARK.sub(lambda m: m[0] if int(m[1]) in allowed else "", text)


def since_year(since_date: str | None, lookback_days: int, today: date | None = None) -> int:
    """Least year of an incremental run: that of the date given (its first four digits), or of the day the window opens."""
    digits = re.sub(r"\D", "", since_date or "")
    return int(digits[:4]) if len(digits) >= 4 else ((today or date.today()) - timedelta(days=lookback_days)).year


def follow(first: DataFrame, then: DataFrame, columns: list[str]) -> DataFrame:
    """The records of both, ``then`` with positions after those of ``first``."""
    top = first.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0] + 1
    return first.unionByName(then.withColumn("pos", F.col("pos") + top), allowMissingColumns=True).select(*columns)


class Review:
    """One run; ``search`` gives records (with the schema's columns) for queries."""

    def __init__(self, spark: SparkSession, search: Search, settings: Settings = Settings(), model: TextModel | None = None, store_root: str | None = None, clock: Callable[[], float] = time.monotonic, as_of_year: int = 2024):
        self.spark, self.search, self.settings, self.model = spark, search, settings, model or OfflineModel()
        self.store = RecordStore(spark, store_root) if store_root and settings.store_enabled else None
        self.tables, self.clock, self.as_of_year = Store(spark, "review"), clock, as_of_year

    # -- control

    def guard(self, name: str, stage: Callable[[ReviewState], None], state: ReviewState) -> None:
        """Run a stage; an error becomes a row and the run goes on."""
        try:
            stage(state)
        except Interrupt:
            raise
        except Exception as e:
            state.errors.append({"node": name, "error": str(e)[:500], "kind": type(e).__name__, "time": time.strftime("%Y-%m-%dT%H:%M:%S")})

    def run(self, topic: str, state: ReviewState | None = None) -> ReviewState:
        """All stages; past the deadline only the closing ones."""
        state, deadline = state or ReviewState(topic), self.clock() + self.settings.watchdog_seconds
        late = lambda: self.clock() > deadline
        while True:
            self.guard("expand", self.expand, state)
            while not late():
                self.guard("retrieve", self.retrieve, state)
                size = state.papers.count() if state.papers is not None else 0
                if size >= self.settings.pool_target or state.retrieval_round >= self.settings.retrieval_rounds:
                    if not size:
                        return state
                    self.guard("rank", self.rank, state)
                    self.guard("auto_expand", self.auto_expand, state)
                    if not state.pending:
                        break
            for name in ("extract", "cluster", "plan_incremental", "write", "ground", "judge", "critic"):
                if not late():
                    self.guard(name, getattr(self, name), state)
            if state.verdict != "need_more" or state.critic_round > self.settings.critic_rounds or late():
                break
        self.guard("find_gaps", self.find_gaps, state)
        self.guard("synthesise", self.synthesise, state)
        return state

    # -- stages

    def expand(self, s: ReviewState) -> None:
        found = ask(self.model, "expand", {"topic": s.topic}, {}) or {}
        raw = [q for q in found.get("queries", []) if isinstance(q, str)] or [s.topic, f"{s.topic} survey", f"{s.topic} review"]
        seen = {q.lower() for q in s.queries}
        for q in raw:
            tidy = re.sub(r"\s+", " ", q.strip().strip("\"'“”")).strip()
            if 2 <= len(tidy) <= 120 and tidy.lower() not in seen:
                seen.add(tidy.lower())
                s.queries.append(tidy)
                s.pending.append(tidy)

    def retrieve(self, s: ReviewState) -> None:
        s.retrieval_round += 1
        limit = min(100, self.settings.results_per_query * s.retrieval_round)
        asked = s.pending or s.queries or [s.topic]
        # Records of earlier runs come before those found now; the window holds for the latter alone.
        known = self.store.recall(asked, self.settings.recall_top_k) if self.store else None
        fresh = self.search(asked, self.settings.with_overrides(results_per_query=limit))
        if self.settings.incremental:
            fresh = fresh.filter(F.coalesce("year", F.lit(0)) >= since_year(s.since_date, self.settings.lookback_days))
        s.pending = []
        for before in (known, s.papers):
            if before is not None:
                fresh = follow(before, fresh, (s.papers if s.papers is not None else fresh).columns)
        pool = dedup.dedup_papers(fresh)
        stored = self.store.read() if self.store else None
        s.papers = self.tables.put(hydrate(pool, stored) if stored is not None else pool, f"pool{s.retrieval_round}-{s.critic_round}")
        if self.store:
            self.store.write(s.papers.withColumn("relevance", F.lit(0.0)))

    def rank(self, s: ReviewState) -> None:
        cfg = self.settings
        central = graph.centrality(s.papers)
        scored = self.tables.put(ranking.relevance(central, s.topic, s.queries), f"scored{s.retrieval_round}-{s.critic_round}")
        gated = ranking.gate(scored, cfg.gate_threshold, cfg.gate_min_keep)
        kept = gated.filter("kept").drop("kept", "gate_rank")
        s.dropped_hubs = [r.title for r in ranking.dropped_hubs(scored, kept, cfg.hub_alert, cfg.hub_alert_limit).collect()]
        s.edge_count = graph.edges_of(s.papers).count()
        top = ranking.top_ranked(ranking.rank(kept, len(s.queries), cfg), cfg.pool_cap)
        total = scored.count()
        s.papers = self.tables.put(top, f"ranked{s.retrieval_round}-{s.critic_round}")
        s.gate = {"total": total, "kept": s.papers.count()}

    def auto_expand(self, s: ReviewState) -> None:
        if s.expanded:
            return
        s.expanded = True
        more = ranking.expand_queries(s.papers, s.topic, s.queries, self.settings)
        s.pending = list(more)
        s.queries += more

    def _pool(self, s: ReviewState) -> list[dict]:
        """The ranked pool; at most pool_cap records."""
        rows = s.papers.orderBy(F.col("score").desc(), "pos").limit(self.settings.pool_cap).collect()
        return [r.asDict(recursive=True) for r in rows]

    def extract(self, s: ReviewState) -> None:
        todo = [p for p in self._pool(s)[: self.settings.extract_limit] if p["paper_id"] not in s.evidence]
        size = self.settings.extract_batch
        batches = [todo[i : i + size] for i in range(0, len(todo), size)]
        answers = ask_many(lambda b: ask(self.model, "extract", {"papers": b}, {}), batches, default={})
        for batch, answer in zip(batches, answers, strict=True):
            found = {e.get("paper_id"): e for e in (answer or {}).get("evidence", []) if isinstance(e, dict)}
            for p in batch:
                fallback = {"paper_id": p["paper_id"], "claim": (p["abstract"] or p["title"])[:200]}
                s.evidence[p["paper_id"]] = found.get(p["paper_id"], fallback)

    def cluster(self, s: ReviewState) -> None:
        covered = s.papers.filter(F.col("paper_id").isin(*s.evidence)) if s.evidence else s.papers
        placed = topics.cluster_papers(covered, self.settings.clusters)
        docs = covered.join(placed, "pos").select(F.col("pos").alias("doc"), F.col("cluster_id").alias("cluster"), F.concat_ws(". ", "title", "title", "abstract").alias("text"))
        words: dict[int, list[str]] = {}
        for r in topics.keywords(docs).orderBy("cluster", "rn").collect():
            words.setdefault(r.cluster, []).append(r.term)
        members: dict[int, list[str]] = {}
        for r in covered.join(placed, "pos").orderBy("cluster_id", F.col("score").desc(), "pos").select("cluster_id", "paper_id").collect():
            members.setdefault(r.cluster_id, []).append(r.paper_id)
        s.clusters = [{"cluster_id": c, "keywords": words.get(c, []), "paper_ids": ids, "size": len(ids), "label": ""} for c, ids in sorted(members.items())]
        labels = (ask(self.model, "name", {"clusters": s.clusters}, {}) or {}).get("labels", {})
        used: set[str] = set()
        for c in s.clusters:
            label = str(labels.get(str(c["cluster_id"]), "")).strip()
            if not label or label in used:
                label = f"主题 {c['cluster_id'] + 1}：" + "、".join(c["keywords"][:3])
            used.add(label)
            c["label"] = label
        new = covered.join(placed, "pos").select("paper_id", "cluster_id", "score", "pos")
        old = self.spark.createDataFrame(list(s.citations.items()), "paper_id string, n long")
        s.citations = {r.paper_id: r.n for r in topics.number_citations(new, old).collect()}

    def plan_incremental(self, s: ReviewState) -> None:
        s.kept_sections = set()
        if not self.settings.incremental or not s.previous_clusters:
            return
        flat = lambda items: self.spark.createDataFrame([(k, p) for k, ids in items for p in ids], "cluster string, paper_id string")
        current = flat((c["label"], c["paper_ids"]) for c in s.clusters)
        written = self.spark.createDataFrame([(k,) for k in s.sections] or [("",)], "cluster string")
        for r in topics.match_versions(current, flat(s.previous_clusters.items()), written, self.settings.keep_overlap).collect():
            if r.kept:
                s.sections[r.cluster] = s.sections[r.prev]
                s.kept_sections.add(r.cluster)

    def _evidence(self, s: ReviewState, cluster: dict) -> list[dict]:
        ids = cluster["paper_ids"][: self.settings.evidence_per_section]
        return [{**s.evidence[p], "n": s.citations[p]} for p in ids if p in s.evidence and p in s.citations]

    def write(self, s: ReviewState) -> None:
        todo = [c for c in s.clusters if c["label"] not in s.kept_sections]
        texts = ask_many(lambda c: self.model.generate("write", {"label": c["label"], "evidence": self._evidence(s, c)}), todo, default="")
        for c, text in zip(todo, texts, strict=True):
            s.sections[c["label"]] = strip_marks(text, {s.citations[p] for p in c["paper_ids"] if p in s.citations})

    def ground(self, s: ReviewState) -> None:
        by_number = {n: p for p, n in s.citations.items()}
        raw = []
        for title, body in s.sections.items():
            cited = [by_number[n] for n in sorted({int(x) for x in _MARK.findall(body)}) if n in by_number]
            if not cited:
                continue
            answer = ask(self.model, "claims", {"section": title, "body": body, "evidence": [s.evidence[p] for p in cited if p in s.evidence]}, {}) or {}
            raw += [(title, i, str(c.get("text", "")), [str(p) for p in c.get("paper_ids", [])], str(c.get("confidence", ""))) for i, c in enumerate(answer.get("claims", []))]
        if not raw:
            return
        claims = self.spark.createDataFrame(raw, "section string, claim_ix int, text string, paper_ids array<string>, confidence string")
        numbers = self.spark.createDataFrame(list(s.citations.items()), "paper_id string, n long")
        rows = audit.ground_claims(claims, numbers).groupBy("section", "claim_ix", "text", "confidence").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "paper_id"))), lambda x: x["paper_id"]).alias("paper_ids"))
        s.claims += [r.asDict() for r in rows.orderBy("section", "claim_ix").collect()]

    def judge(self, s: ReviewState) -> None:
        if not self.settings.faithfulness_enabled or not s.claims:
            s.faithfulness = {"skipped": True}
            return
        found = ask_many(lambda c: ask(self.model, "judge", {"claim": c["text"], "evidence": [s.evidence.get(p) for p in c["paper_ids"]]}, {}), s.claims, default={})
        rows = self.spark.createDataFrame([(str((v or {}).get("verdict", "")),) for v in found], "verdict string")
        s.faithfulness = audit.faithfulness(rows).first().asDict()

    def critic(self, s: ReviewState) -> None:
        s.critic_round += 1
        answer = ask(self.model, "critic", {"sections": s.sections}, {}) or {}
        s.verdict = "need_more" if str(answer.get("verdict", "")).lower().startswith("need") else "pass"
        if s.verdict == "need_more":
            s.pending = [q for q in answer.get("extra_queries", []) if isinstance(q, str)]

    def find_gaps(self, s: ReviewState) -> None:
        answer = ask(self.model, "gaps", {"topic": s.topic}, {}) or {}
        refs = s.papers.select(F.col("paper_id").alias("paper"), F.explode("referenced_works").alias("ref")).withColumn("ref", F.substring_index("ref", "/", -1))
        covered = self.spark.createDataFrame([(p,) for c in s.clusters for p in c["paper_ids"]] or [("",)], "paper string")
        mined = [r.sentence for r in graph.gap_sentences(refs, s.papers, covered, self.settings.coupling_min_shared).orderBy("component").collect()]
        s.gaps = list(dict.fromkeys([*[g for g in answer.get("gaps", []) if isinstance(g, str)], *mined]))

    def synthesise(self, s: ReviewState) -> None:
        numbers = self.spark.createDataFrame(list(s.citations.items()) or [("", 0)], "paper_id string, n long")
        cited = s.papers.join(F.broadcast(numbers), "paper_id")
        c = F.col
        bases = cited.select("paper_id", "n", bibliography.cite_key_base(c("authors"), c("year"), c("title")).alias("base")).orderBy("n").collect()
        keys = dict(zip([r.paper_id for r in bases], audit.fold_cite_keys([r.base for r in bases]), strict=True))
        named = cited.join(F.broadcast(self.spark.createDataFrame(list(keys.items()) or [("", "")], "paper_id string, key string")), "paper_id")
        entry = bibliography.bibtex_entry(c("key"), c("paper_id"), c("title"), c("authors"), c("year"), c("venue"), c("doi"), c("url"), c("source"))
        line = bibliography.reference_line(c("n"), c("authors"), c("year"), c("title"), c("venue"), c("citation_count"), c("doi"), c("url"))
        rows = named.select("n", entry.alias("entry"), line.alias("line")).orderBy("n").collect()
        clusters = self.spark.createDataFrame([(x["cluster_id"], x["label"], x["paper_ids"], x["size"]) for x in s.clusters] or [(0, "", [], 0)], "cluster_id int, label string, paper_ids array<string>, size int").filter("size > 0")
        sections = self.spark.createDataFrame(list(s.sections.items()) or [("", "")], "title string, body string").filter("title <> ''")
        claims = self.spark.createDataFrame([(x["confidence"],) for x in s.claims] or [("",)], "confidence string").filter("confidence <> ''")
        faith = None if not s.faithfulness or s.faithfulness.get("skipped") else self.spark.createDataFrame([(s.faithfulness["score"], s.faithfulness["checked"])], "score double, checked long")
        dims = audit.scorecard(audit.ScoreInputs(s.papers, sections, clusters, claims, faith, s.edge_count, len(s.dropped_hubs), len(s.gaps), self.as_of_year))
        quality = {**audit.overall(dims).first().asDict(), "dimensions": [r.asDict() for r in dims.collect()]}
        body = "\n\n".join(f"## {t}\n\n{b}" for t, b in s.sections.items())
        s.outputs = {
            "review.md": f"# {s.topic}\n\n{body}\n\n## 参考文献\n\n" + "\n\n".join(r.line for r in rows) + "\n",
            "references.bib": "\n\n".join(r.entry for r in rows) + "\n",
            "papers.json": "\n".join(s.papers.join(F.broadcast(numbers.withColumnRenamed("n", "citation_index")), "paper_id", "left").toJSON().collect()),
            "meta.json": json.dumps({"sections": s.sections, "clusters": s.clusters}, ensure_ascii=False),
            "citation_graph.json": graph.export_graph(s.papers, graph.edges_of(s.papers), clusters, s.gaps).first().graph,
            "quality_report.json": json.dumps(quality, ensure_ascii=False),
            "review.tex": to_latex(s.topic, s.sections, {s.citations[p]: k for p, k in keys.items()}),
        }

    # -- a person's part

    def resume(self, s: ReviewState, feedback: str) -> bool:
        """Apply feedback: True when it approves, else the named sections are rewritten or added and re-grounded."""
        if feedback.strip().lower() in {"", "ok", "yes", "approve", "approved", "pass", "通过", "同意"}:
            return True
        targets = (ask(self.model, "feedback", {"feedback": feedback, "sections": list(s.sections)}, {}) or {}).get("targets", [])
        for t in targets:
            words = re.findall(r"\w+", f"{t.get('section', '')} {t.get('instruction', '')}".lower())
            frame = self.spark.createDataFrame([(c["cluster_id"], c["label"], c["keywords"]) for c in s.clusters], "cluster_id int, label string, keywords array<string>")
            hit = topics.best_cluster(words, frame).first()
            chosen = next((c for c in s.clusters if hit and c["cluster_id"] == hit.cluster_id), None)
            if chosen:
                title = t.get("section") or chosen["label"]
                text = self.model.generate("write", {"label": title, "evidence": self._evidence(s, chosen), "instruction": t.get("instruction", "")})
                s.sections[title] = strip_marks(text, {s.citations[p] for p in chosen["paper_ids"] if p in s.citations})
        self.guard("ground", self.ground, s)
        self.guard("judge", self.judge, s)
        self.guard("synthesise", self.synthesise, s)
        return False


# Fixed value: characters with a meaning in LaTeX and how each is written.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def to_latex(topic: str, sections: dict[str, str], keys: dict[int, str]) -> str:
    """Sections with escapes in one pass and marks as citations."""
    safe = lambda t: "".join(LATEX.get(ch, ch) for ch in t)
    cite = lambda t: _MARK.sub(lambda m: rf"\cite{{{keys[int(m[1])]}}}" if int(m[1]) in keys else f"[noref:{m[1]}]", t)
    parts = "\n\n".join(rf"\section{{{safe(t)}}}" + "\n" + cite(safe(b)) for t, b in sections.items())
    return "\\documentclass{article}\n\\begin{document}\n\\title{" + safe(topic) + "}\n\\maketitle\n" + parts + "\n\\bibliography{references}\n\\end{document}\n"


def load_previous(spark: SparkSession, base: str) -> ReviewState | None:
    """State of an earlier version from its papers and meta files; None if neither is there."""
    state = ReviewState("")
    try:
        rows = spark.read.json(f"{base}_papers.json").select("paper_id", "citation_index").filter("citation_index is not null").collect()
        state.citations = {r.paper_id: r.citation_index for r in rows}
    except Exception:
        rows = None
    try:
        meta = json.loads(spark.read.text(f"{base}_meta.json", wholetext=True).first().value)
        state.sections = meta.get("sections", {})
        state.previous_clusters = {c["label"]: c["paper_ids"] for c in meta.get("clusters", [])}
    except Exception:
        return state if rows else None
    return state
