"""Response cache, request gaps and retry rules of remote sources."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import threading
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

# Least seconds between requests to a source.
GAPS = {"arxiv": 3.0, "openalex": 0.12, "semantic_scholar": 3.2, "pubmed": 0.34, "crossref": 0.1, "unpaywall": 0.15, "pdf": 1.0}
TRANSIENT = ("timeout", "timed out", "connection", "reset by peer", "econnreset", "broken pipe", "temporarily", "503", "502", "504", "500", "service unavailable", "gateway timeout", "bad gateway")


def cache_key(source: str, url: str, params: Mapping[str, object] | None) -> str:
    """First 32 hex digits of the SHA-256 of the sorted request."""
    request = json.dumps({"source": source, "url": url, "params": dict(params or {})}, sort_keys=True, default=str)
    return hashlib.sha256(request.encode()).hexdigest()[:32]


@dataclass
class ResponseCache:
    """One file per response; a TTL of 0 never expires; errors are neither kept nor served."""

    root: str
    ttl_days: float = 7
    now: Callable[[], float] = time.time

    def get(self, key: str) -> str | None:
        path = os.path.join(self.root, key + ".json")
        try:
            with open(path, encoding="utf-8") as f:
                record = json.load(f)
        except (OSError, ValueError):
            return None
        fresh = self.ttl_days == 0 or self.now() - record["ts"] <= self.ttl_days * 86_400
        return record["body"] if fresh and record["status"] < 400 else None

    def put(self, key: str, status: int, body: str) -> None:
        if status >= 400:
            return
        os.makedirs(self.root, exist_ok=True)
        handle, path = tempfile.mkstemp(dir=self.root)
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump({"ts": self.now(), "status": status, "body": body}, f)
        os.replace(path, os.path.join(self.root, key + ".json"))


@dataclass
class RateLimiter:
    """Holds callers until the gap since the last request has passed."""

    gap: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    _lock: threading.Lock = field(default_factory=threading.Lock)
    _last: float = float("-inf")

    def wait(self) -> None:
        with self._lock:
            rest = self._last + self.gap - self.clock()
            if rest > 0:
                self.sleep(rest)
            self._last = self.clock()


def transient(error: BaseException | str) -> bool:
    """Whether an error reads like one that a retry may get past."""
    text = str(error).lower()
    return any(mark in text for mark in (*TRANSIENT, "429", "rate limit", "too many requests"))


def fetch(call: Callable[[], tuple[int, str]], cache: ResponseCache | None, key: str, limiter: RateLimiter | None = None, retries: int = 2, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """A response body from the cache or the call; backs off 3 * 2^n s when told to slow down, n s on errors; None in the end."""
    if cache and (hit := cache.get(key)) is not None:
        return hit
    for attempt in range(retries + 1):
        if limiter:
            limiter.wait()
        try:
            status, body = call()
        except OSError:
            sleep(attempt + 1)
            continue
        if status == 429:
            sleep(3 * 2**attempt)
            continue
        if status >= 400:
            return None
        if cache:
            cache.put(key, status, body)
        return body
    return None
