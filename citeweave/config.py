"""Immutable settings of a run."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    """Defaults of retrieval, ranking, expansion, clustering and rendering."""

    results_per_query: int = 25
    pool_target: int = 40
    pool_cap: int = 120
    retrieval_rounds: int = 3
    critic_rounds: int = 2
    human_rounds: int = 2
    fulltext_top_n: int = 8
    clusters: int = 0
    min_year: int = 0
    gate_threshold: float = 0.10
    gate_min_keep: int = 20
    weight_relevance: float = 0.55
    weight_citations: float = 0.20
    weight_recency: float = 0.15
    weight_coverage: float = 0.10
    weight_hub: float = 0.10
    expand_enabled: bool = True
    expand_top_k: int = 12
    expand_max_queries: int = 5
    incremental: bool = False
    lookback_days: int = 180
    hub_alert: float = 0.6
    hub_alert_limit: int = 10
    coupling_min_shared: int = 2
    keep_overlap: float = 0.5
    extract_limit: int = 60
    extract_batch: int = 5
    evidence_per_section: int = 15
    cache_ttl_days: int = 7
    watchdog_seconds: float = 1800.0
    sources: tuple[str, ...] = ("arxiv", "openalex")
    faithfulness_enabled: bool = True
    store_enabled: bool = True
    recall_top_k: int = 15

    def with_overrides(self, **values: object) -> Settings:
        """A copy with the given values; None leaves a default as it is."""
        return replace(self, **{k: v for k, v in values.items() if v is not None})


def _coerce(raw: str, default: object) -> object:
    """Text as the default's type; the default itself where it does not parse."""
    text = raw.strip()
    if isinstance(default, bool):
        return text.lower() in {"1", "true", "yes", "on"} if text else default
    if isinstance(default, tuple):
        parts = tuple(p.strip() for p in text.split(",") if p.strip())
        return parts or default
    try:
        return type(default)(text)
    except ValueError:
        return default


def settings_from_env(prefix: str = "CITEWEAVE_", env: Mapping[str, str] | None = None) -> Settings:
    """Settings with values from the environment, without changing it."""
    env = os.environ if env is None else env
    base = Settings()
    found = {f.name: _coerce(env[prefix + f.name.upper()], getattr(base, f.name)) for f in fields(base) if prefix + f.name.upper() in env}
    return replace(base, **found)
