"""Text expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A heading that opens the reference section, and the mark of an omitted middle.
REFERENCES_HEADING = r"(?im)\n\s*(references|bibliography|参考文献)\s*\n"
OMITTED = "\n\n...[中间内容省略]...\n\n"


def blank(c: Column) -> Column:
    """Missing in the loose sense: null or the empty string."""
    return c.isNull() | (c == "")


def filled(c: Column) -> Column:
    """The value, or null where it is blank."""
    return F.when(~blank(c), c)


def clean_text(c: Column) -> Column:
    """White space runs (Unicode) to one space, ends trimmed; null to the empty string."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def strip_markup(c: Column) -> Column:
    """Tags to spaces, no space before punctuation, then cleaned."""
    bare = F.regexp_replace(c, "<[^>]+>", " ")
    return clean_text(F.regexp_replace(bare, r"\s+([.,;:!?])", "$1"))


def slug(c: Column) -> Column:
    """File-name form: runs of other than word or CJK characters to one underscore, 60 characters, never empty."""
    s = F.regexp_replace(c, r"[^0-9A-Za-z_\u4e00-\u9fff]+", "_")
    return F.coalesce(filled(F.substring(F.regexp_replace(s, "^_+|_+$", ""), 1, 60)), F.lit("review"))


def condense(c: Column, head: int = 6000, tail: int = 3000) -> Column:
    """Long text to its head and tail with a mark between; shorter text unchanged."""
    whole = F.coalesce(c, F.lit(""))
    cut = F.concat(F.substring(whole, 1, head), F.lit(OMITTED), F.expr("''") if tail == 0 else F.right(whole, F.lit(tail)))
    return F.when(F.length(whole) <= head + tail, whole).otherwise(cut)


def without_references(c: Column) -> Column:
    """Text cut at its first reference heading, if that stands past 40 % of it."""
    text = F.coalesce(c, F.lit(""))
    at = F.regexp_instr(text, F.lit(REFERENCES_HEADING))
    return F.when((at > 0) & (at - 1 > F.length(text) * 0.4), F.substring(text, F.lit(1), at - 1)).otherwise(text)


def clean_fulltext(c: Column) -> Column:
    """Reference section dropped, blank-line runs and space runs collapsed, trimmed."""
    text = F.regexp_replace(without_references(c), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(text, r"[ \t]{2,}", " "))


def first_line(c: Column) -> Column:
    """Everything before the first line break."""
    return F.substring_index(c, "\n", 1)


def tokens(c: Column, pattern: str = r"[a-z][a-z0-9\-]{2,}") -> Column:
    """Matches of a token pattern over the lower-cased text; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    """Adjacent pairs of an array of words, joined by a space."""
    count = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), count), F.slice(words, F.lit(2), count), lambda a, b: F.concat(a, F.lit(" "), b))
