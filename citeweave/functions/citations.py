"""Expressions over numbered citation marks such as [3]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = r"\[(\d{1,3})\]"


def cited_numbers(c: Column) -> Column:
    """Distinct cited numbers, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(MARK), F.lit(1)), lambda n: n.cast("int"))))


def has_citation(c: Column) -> Column:
    """Whether a text carries a mark."""
    return F.coalesce(c, F.lit("")).rlike(r"\[\d{1,3}\]")


def strip_invalid(c: Column, allowed: Column) -> Column:
    """Text without the marks whose number is not in the array ``allowed``; other text stays."""
    # Split before each mark; every part after the first then begins with one.
    parts = F.split(F.coalesce(c, F.lit("")), r"(?=\[\d{1,3}\])")
    number = lambda p: F.regexp_extract(p, r"^\[(\d{1,3})\]", 1)
    keep = lambda p: F.when((number(p) != "") & ~F.array_contains(allowed, number(p).try_cast("int")), F.regexp_replace(p, r"^\[\d{1,3}\]", "")).otherwise(p)
    return F.array_join(F.transform(parts, keep), "")
