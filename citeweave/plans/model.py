"""The text model's protocol, a deterministic offline stand-in, and ordered batch calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

from ..functions.jsonfix import repaired_json


class TextModel(Protocol):
    """Anything that answers a task's fields with text."""

    def generate(self, task: str, fields: dict[str, Any]) -> str: ...


class OfflineModel:
    """Answers that are pure functions of the fields; for tests and runs without a network."""

    def generate(self, task: str, fields: dict[str, Any]) -> str:
        answer = getattr(self, f"_{task}", lambda f: {})(fields)
        return answer if isinstance(answer, str) else json.dumps(answer, ensure_ascii=False)

    def _expand(self, f: dict) -> dict:
        return {"queries": [f["topic"], f"{f['topic']} survey", f"{f['topic']} methods"]}

    def _extract(self, f: dict) -> dict:
        return {"evidence": [{"paper_id": p["paper_id"], "claim": (p["abstract"] or p["title"])[:200], "method": "", "dataset": "", "metric": ""} for p in f["papers"]]}

    def _name(self, f: dict) -> dict:
        return {"labels": {str(c["cluster_id"]): " ".join(c["keywords"][:3]) for c in f["clusters"]}}

    def _write(self, f: dict) -> str:
        return " ".join(f"{e['claim']} [{e['n']}]." for e in f["evidence"])

    def _claims(self, f: dict) -> dict:
        return {"claims": [{"text": e["claim"], "paper_ids": [e["paper_id"]], "confidence": "high"} for e in f["evidence"]]}

    def _judge(self, f: dict) -> dict:
        return {"verdict": "supported", "reason": ""}

    def _critic(self, f: dict) -> dict:
        return {"verdict": "pass", "coverage_score": 8, "extra_queries": []}

    def _gaps(self, f: dict) -> dict:
        return {"gaps": [], "trends": []}

    def _feedback(self, f: dict) -> dict:
        return {"targets": []}


def ask(model: TextModel, task: str, fields: dict[str, Any], default: Any = None) -> Any:
    """A JSON answer; the default where it cannot be read."""
    fixed = repaired_json(model.generate(task, fields))
    return default if fixed is None else json.loads(fixed)


def ask_many(call: Callable[[Any], Any], items: Sequence[Any], workers: int = 4, default: Any = None) -> list[Any]:
    """Answers in the order of the items; a call that fails gives the default and does not stop the rest."""

    def safe(item: Any) -> Any:
        try:
            return call(item)
        except Exception:
            return default

    if workers <= 1 or len(items) <= 1:
        return [safe(i) for i in items]
    with ThreadPoolExecutor(min(workers, len(items))) as pool:
        return list(pool.map(safe, items))
