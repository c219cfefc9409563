"""Fields of Atom entries and Medline articles, one document a row.

The XPath functions of SQL fail the job on a document that is not well-formed,
and return lists without telling which element each value came from, so authors
without a given name would shift the names of those after them.  Here each
document is read as a tree, in Arrow batches; one that is not well-formed (or
null) gives null in every field and ``sound`` false.  Namespaces are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ATOM = "sound boolean, id string, title string, published string, summary string, journal string, doi string, pdf string, authors array<string>"
MEDLINE = "sound boolean, pmid string, title string, abstract string, journal string, dois array<string>, years array<string>, authors array<struct<last:string,fore:string,initials:string>>"


def _tree(payload: str | None) -> ElementTree.Element | None:
    if payload is None:
        return None
    try:
        root = ElementTree.fromstring(payload)
    except ElementTree.ParseError:
        return None
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    return root


def _text(at: ElementTree.Element | None, path: str = ".") -> str | None:
    """All text inside the first element at ``path``, marks in it included; null without one."""
    found = None if at is None else at.find(path)
    return None if found is None else "".join(found.itertext())


def _atom(root: ElementTree.Element) -> dict:
    entry = root if root.tag == "entry" else ElementTree.Element("entry")
    links = (link.get("href") for link in entry.findall("link") if link.get("title") == "pdf")
    one = {field: _text(entry, tag) for field, tag in (("id", "id"), ("title", "title"), ("published", "published"), ("summary", "summary"), ("journal", "journal_ref"), ("doi", "doi"))}
    return {"sound": True, **one, "pdf": next(links, None), "authors": [_text(a, "name") or "" for a in entry.findall("author")]}


def _medline(root: ElementTree.Element) -> dict:
    article = root.find(".//Article")
    inside = ElementTree.Element("Article") if article is None else article
    segments = (" ".join(_text(s).split()) for s in inside.findall("Abstract/AbstractText"))
    places = ("ArticleDate/Year", "Journal/JournalIssue/PubDate/Year", "Journal/JournalIssue/PubDate/MedlineDate")
    return {
        "sound": True, "pmid": _text(root, ".//PMID"), "title": _text(inside, "ArticleTitle"), "abstract": " ".join(filter(None, segments)), "journal": _text(inside, "Journal/Title"),
        "dois": [e.text for e in inside.iter("ELocationID") if e.get("EIdType") == "doi" and e.get("ValidYN", "Y") != "N"],
        "years": [_text(e) for p in places for e in inside.findall(p)],
        "authors": [{"last": _text(a, "LastName"), "fore": _text(a, "ForeName"), "initials": _text(a, "Initials")} for a in inside.findall("AuthorList/Author")],
    }


def _fields(payload: Column | str, read: Callable[[ElementTree.Element], dict], schema: str) -> Column:
    columns = [field.split()[0] for field in schema.split(", ")]

    @F.pandas_udf(schema)
    def fields(payloads: pd.Series) -> pd.DataFrame:
        trees = (_tree(p) for p in payloads)
        return pd.DataFrame([dict.fromkeys(columns) | ({"sound": False} if t is None else read(t)) for t in trees], columns=columns, dtype=object)

    return fields(payload)


def atom_fields(payload: Column | str) -> Column:
    """One Atom entry as a structure of the fields in ``ATOM``."""
    return _fields(payload, _atom, ATOM)


def medline_fields(payload: Column | str) -> Column:
    """One Medline article as a structure of the fields in ``MEDLINE``."""
    return _fields(payload, _medline, MEDLINE)
