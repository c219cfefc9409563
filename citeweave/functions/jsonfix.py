"""Repair and parsing of JSON embedded in a model's answer."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
_TRAILING_COMMA = re.compile(r",\s*([}\]])")


def _balanced(text: str, start: int) -> int | None:
    """End of the bracket opened at ``start``, minding strings; None if it never closes."""
    opener = text[start]
    closer = {"{": "}", "[": "]"}[opener]
    depth = 0
    for m in re.finditer(r'"(?:\\.|[^"\\])*(?:"|$)|[\[\]{}]', text[start:], re.DOTALL):
        depth += (m[0] == opener) - (m[0] == closer)
        if not depth:
            return start + m.end()
    return None


def json_blob(text: str | None) -> str:
    """The first balanced object, else array, of a text (inside a fence, if there is one); else the text."""
    body = (text or "").strip()
    fence = _FENCE.search(body)
    body = fence[1].strip() if fence else body
    for opener in "{[":
        at = body.find(opener)
        end = _balanced(body, at) if at >= 0 else None
        if end:
            return body[at:end]
    return body


def repaired_json(text: str | None) -> str | None:
    """Valid JSON text for an answer, or None: as it stands, or without trailing commas and curly quotes."""
    blob = json_blob(text)
    for candidate in (blob, _TRAILING_COMMA.sub(r"\1", blob).replace("“", '"').replace("”", '"')):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except ValueError:
            continue
    return None


def repair_json(c: Column) -> Column:
    """Column form of :func:`repaired_json`, in Arrow batches (bracket balancing is beyond regular expressions)."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(repaired_json)

    return run(c)
