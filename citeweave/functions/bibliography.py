"""Expressions that render bibliography entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, filled

# DOI prefixes and the publisher or journal each names, first match wins.
PUBLISHERS = (
    ("10.1364/ao", "Applied Optics"),
    ("10.1364/oe", "Optics Express"),
    ("10.1364/ol", "Optics Letters"),
    ("10.1364/boe", "Biomedical Optics Express"),
    ("10.1364", "Optics (OSA)"),
    ("10.1109", "IEEE"),
    ("10.1038", "Nature"),
    ("10.1016", "Elsevier"),
    ("10.1007", "Springer"),
    ("10.1145", "ACM"),
    ("10.1088", "IOP Publishing"),
    ("10.1117", "SPIE"),
    ("10.1115", "ASME"),
    ("10.3390", "MDPI"),
    ("10.1093", "Oxford University Press"),
    ("10.1080", "Taylor & Francis"),
    ("10.1002", "Wiley"),
    ("10.1186", "BMC"),
    ("10.1177", "SAGE"),
)
# Fixed value: title words that no cite key takes.
KEY_STOP_WORDS = ("a", "an", "the", "on", "of", "in", "for", "to", "and", "with", "towards", "via")
# Fixed value: characters with a meaning in BibTeX and how each is written.
ESCAPES = (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))
PROCEEDINGS = ("conference", "proceedings", "workshop", "symposium")


def publisher_of(doi: Column) -> Column:
    """Publisher named by a DOI's prefix, or null."""
    low, out = F.lower(doi), F.lit(None).cast("string")
    for prefix, name in reversed(PUBLISHERS):
        out = F.when(F.startswith(low, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def effective_venue(venue: Column, doi: Column) -> Column:
    """The venue, or the DOI's publisher where the venue is blank or a preprint's."""
    v = F.trim(F.coalesce(venue, F.lit("")))
    preprint = (v == "") | F.contains(F.lower(v), F.lit("arxiv")) | (F.lower(v) == "preprint")
    return F.when(preprint & publisher_of(doi).isNotNull(), publisher_of(doi)).otherwise(v)


def entry_type(source: Column, venue: Column, doi: Column) -> Column:
    """misc for preprints without a publisher's DOI, inproceedings by the venue's words, else article."""
    v = F.lower(effective_venue(venue, doi))
    preprint = (F.coalesce(source, F.lit("")) == "arxiv") | F.contains(v, F.lit("arxiv")) | F.contains(v, F.lit("preprint"))
    meeting = v.rlike("|".join(PROCEEDINGS))
    return F.when(preprint & publisher_of(doi).isNull(), "misc").when(meeting, "inproceedings").otherwise("article")


def escape(c: Column) -> Column:
    """BibTeX escapes; the two whose escapes hold braces come last, so that no escape is escaped again."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"([&%$#_{}])", r"\\$1")
    for ch, written in ESCAPES:
        if ch in "~^":
            out = F.replace(out, F.lit(ch), F.lit(written))
    return out


def last_name(author: Column) -> Column:
    """Before the comma, else the last word; 'anon' for none."""
    name = F.trim(F.coalesce(author, F.lit("")))
    last = F.when(F.contains(name, F.lit(",")), F.trim(F.substring_index(name, ",", 1))).otherwise(F.element_at(F.split(name, r"\s+"), -1))
    return F.coalesce(filled(last), F.lit("anon"))


def cite_key_base(authors: Column, year: Column, title: Column) -> Column:
    """Last name, year and first telling title word; collisions are resolved by the caller."""
    last = F.lower(F.regexp_replace(last_name(F.try_element_at(authors, F.lit(1))), "[^A-Za-z]", ""))
    words = F.filter(F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)), F.lower), lambda w: (F.length(w) > 2) & ~w.isin(*KEY_STOP_WORDS))
    year_text = F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string")).otherwise("nd")
    return F.concat(F.coalesce(filled(last), F.lit("anon")), year_text, F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("untitled")))


def bibtex_entry(key: Column, paper_id: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, url: Column, source: Column) -> Column:
    """One BibTeX entry; blank fields are left out."""
    kind, v = entry_type(source, venue, doi), effective_venue(venue, doi)
    year_text = F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string"))
    eprint = F.when((kind == "misc") & F.startswith(paper_id, F.lit("arxiv:")), F.substring(paper_id, F.lit(7), F.length(paper_id)))
    fields = [
        ("title", escape(title)),
        ("author", escape(F.array_join(authors, " and "))),
        ("year", year_text),
        ("booktitle", F.when(kind == "inproceedings", escape(v))),
        ("journal", F.when(kind == "article", escape(v))),
        ("eprint", filled(eprint)),
        ("archivePrefix", F.when(~blank(eprint), F.lit("arXiv"))),
        ("howpublished", F.when(kind == "misc", escape(F.coalesce(filled(v), F.lit("Preprint"))))),
        ("doi", doi),
        ("url", url),
    ]
    lines = F.array_compact(F.array(*(F.when(~blank(value), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}"))) for name, value in fields)))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def authors_inline(authors: Column, most: int = 3) -> Column:
    """Up to ``most`` names, then 'et al.'; 'Anon.' for none."""
    names = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: ~blank(a))
    return F.when(F.size(names) == 0, "Anon.").when(F.size(names) <= most, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" et al.")))


def reference_line(number: Column, authors: Column, year: Column, title: Column, venue: Column, citations: Column, doi: Column, url: Column) -> Column:
    """One Markdown line of the reference list."""
    v = effective_venue(venue, doi)
    head = F.concat(F.lit("**["), number.cast("string"), F.lit("]** "), authors_inline(authors), F.lit(" ("), F.coalesce(F.when(year != 0, year.cast("string")), F.lit("n.d.")), F.lit("). *"), F.coalesce(filled(title), F.lit("(untitled)")), F.lit("*."))
    link = F.when(~blank(doi), F.concat(F.lit("DOI: ["), doi, F.lit("](https://doi.org/"), doi, F.lit(")"))).when(~blank(url), F.concat(F.lit("[链接]("), url, F.lit(")")))
    bits = F.array(head, F.when(v != "", F.concat(v, F.lit("."))), F.when(F.coalesce(citations, F.lit(0)) != 0, F.concat(F.lit("被引 "), citations.cast("string"), F.lit("."))), link)
    return F.array_join(F.array_compact(bits), " ")
