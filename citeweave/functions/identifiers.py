"""Identifier expressions: DOIs, title fingerprints, versioned ids, entity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, filled

# DOI prefixes in the order they are stripped, and the valid form.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi.org/", "doi:")
DOI_FORM = r"^10\.\d{1,9}/\S+$"
FINGERPRINT_MIN = 12


def normalize_doi(c: Column) -> Column:
    """Lower-cased DOI without prefixes or closing dots; null where it is not a DOI."""
    d = F.lower(F.trim(c))
    for prefix in DOI_PREFIXES:
        # One reference to d a step, so that the expression grows with the prefixes and not with their powers.
        d = F.regexp_replace(d, "^" + prefix.replace(".", r"\."), "")
    d = F.trim(F.regexp_replace(F.trim(d), r"\.+$", ""))
    return F.nullif(F.regexp_extract(d, f"({DOI_FORM})", 1), F.lit(""))


def title_fingerprint(c: Column) -> Column:
    """Only the lower-cased ASCII letters and digits of a title."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def unversioned_id(c: Column) -> Column:
    """An id without its closing version mark."""
    return F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"v\d+$", "")


def last_segment(c: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def _title_key(title: Column) -> Column:
    fp = title_fingerprint(title)
    return F.when(F.length(fp) >= FINGERPRINT_MIN, F.concat(F.lit("title:"), fp))


def entity_keys(doi: Column, paper_id: Column, title: Column) -> Column:
    """Keys of a record by priority: DOI, versionless preprint id, long title fingerprint; else its id."""
    keys = F.array_compact(F.array(F.when(~blank(doi), F.concat(F.lit("doi:"), doi)), F.when(F.startswith(paper_id, F.lit("arxiv:")), paper_id), _title_key(title)))
    return F.when(F.size(keys) > 0, keys).otherwise(F.array_compact(F.array(filled(paper_id))))


def store_key(doi: Column, paper_id: Column, title: Column) -> Column:
    """One key of a record: DOI, preprint id, long fingerprint, id, short fingerprint."""
    return F.coalesce(
        F.when(~blank(doi), F.concat(F.lit("doi:"), doi)),
        F.when(F.startswith(paper_id, F.lit("arxiv:")), paper_id),
        _title_key(title),
        filled(paper_id),
        F.when(title_fingerprint(title) != "", F.concat(F.lit("title:"), title_fingerprint(title))),
    )


def arxiv_query(c: Column) -> Column:
    """A search text in the preprint index's syntax: prefixed text as it is, else all terms joined by AND."""
    q = F.trim(c)
    words = F.filter(F.split(F.replace(q, F.lit('"'), F.lit(" ")), r"\s+"), lambda w: w != "")
    term = lambda w: F.when(F.contains(w, F.lit("-")), F.concat(F.lit('all:"'), w, F.lit('"'))).otherwise(F.concat(F.lit("all:"), w))
    return F.when(q.rlike("^(ti|abs|au|cat|all):"), q).when(F.size(words) <= 1, F.concat(F.lit("all:"), q)).otherwise(F.array_join(F.transform(words, term), " AND "))


def filter_value(c: Column) -> Column:
    """A value safe inside a source's filter syntax, at most 110 characters."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "[,:|()\\[\\]{}<>\"'&+]", " ")
    return F.rtrim(F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, 110))


def rebuild_abstract(index: Column) -> Column:
    """Text of an inverted index (map of word to positions); ties by word."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), r"\s+", " ")), F.lit(""))
