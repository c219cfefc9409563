"""Column functions on literal values."""

import pytest
from pyspark.sql import functions as F

from citeweave.functions import bibliography, citations, identifiers, jsonfix, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [
    ("https://doi.org/10.1000/ABC", "10.1000/abc"), ("doi:10.1000/abc", "10.1000/abc"), (None, None), ("", None), ("not a doi", None),
    ("doi:something invalid", None), ("10.1364/ao.49.00g148 ", "10.1364/ao.49.00g148"), ("10.1/x..", "10.1/x"),
])
def test_doi(spark, raw, want):
    assert one(spark, identifiers.normalize_doi(F.lit(raw).cast("string"))) == want


def test_identifiers(spark):
    assert one(spark, identifiers.unversioned_id(F.lit("2301.00001v3"))) == "2301.00001"
    assert one(spark, identifiers.title_fingerprint(F.lit("Attention is All-You Need!"))) == "attentionisallyouneed"
    key = lambda d, p, t: one(spark, identifiers.store_key(F.lit(d).cast("string"), F.lit(p).cast("string"), F.lit(t).cast("string")))
    assert key("10.1/x", "arxiv:1", "t") == "doi:10.1/x" and key(None, "arxiv:1", "t") == "arxiv:1"
    assert key(None, "s2:1", "A long enough title") == "title:alongenoughtitle" and key(None, "s2:1", "short") == "s2:1" and key(None, "", "short") == "title:short"


def test_inverted_index(spark):
    m = F.create_map(*(x for k, v in {"Deep": [0], "learning": [1, 4], "is": [2], "great": [3]}.items() for x in (F.lit(k), F.lit(v))))
    assert one(spark, identifiers.rebuild_abstract(m)) == "Deep learning is great learning"
    assert one(spark, identifiers.rebuild_abstract(F.lit(None).cast("map<string,array<int>>"))) == ""


@pytest.mark.parametrize(("q", "want"), [("ti:x y", "ti:x y"), ("graph", "all:graph"), ("graph self-attention", 'all:graph AND all:"self-attention"')])
def test_query_syntax(spark, q, want):
    assert one(spark, identifiers.arxiv_query(F.lit(q))) == want


def test_text(spark):
    assert one(spark, text.clean_text(F.lit("  a  b\n\tc "))) == "a b c"
    assert one(spark, text.strip_markup(F.lit("<p>things <b>x</b> .</p>"))) == "things x."
    assert one(spark, text.slug(F.lit("!!"))) == "review" and one(spark, text.slug(F.lit("a b/c"))) == "a_b_c"
    long = "x" * 60 + "\nReferences\n" + "y" * 20
    assert one(spark, text.clean_fulltext(F.lit(long))) == "x" * 60
    assert one(spark, text.clean_fulltext(F.lit("a\nReferences\n" + "y" * 60))).endswith("y")
    assert one(spark, F.length(text.condense(F.lit("z" * 10_000)))) == 9000 + len(text.OMITTED)


def test_citations(spark):
    t = F.lit("a [1][99] b [2] [01] c")
    assert one(spark, citations.cited_numbers(t)) == [1, 2, 99]
    assert one(spark, citations.strip_invalid(t, F.array(F.lit(1), F.lit(2)))) == "a [1] b [2] [01] c"


def test_bibliography(spark):
    names = [("10.1364/AO.1", "Applied Optics"), ("10.1364/OE.1", "Optics Express"), ("10.1109/5", "IEEE"), ("10.1038/x", "Nature"), ("10.9999/x", None)]
    for doi, want in names:
        assert one(spark, bibliography.publisher_of(F.lit(doi))) == want
    assert one(spark, bibliography.escape(F.lit("a&b_{~}^%"))) == r"a\&b\_\{\textasciitilde{}\}\textasciicircum{}\%"
    key = bibliography.cite_key_base(F.array(F.lit("Ashish Vaswani")), F.lit(2017), F.lit("The Attention Is All"))
    assert one(spark, key) == "vaswani2017attention"
    assert one(spark, bibliography.authors_inline(F.array(*map(F.lit, "abcd")))) == "a, b, c et al."
    entry = bibliography.bibtex_entry(F.lit("k"), F.lit("arxiv:1.2"), F.lit("T"), F.array(F.lit("A")), F.lit(2020), F.lit("arXiv preprint"), F.lit(None).cast("string"), F.lit(""), F.lit("arxiv"))
    assert one(spark, entry) == "@misc{k,\n  title = {T},\n  author = {A},\n  year = {2020},\n  eprint = {1.2},\n  archivePrefix = {arXiv},\n  howpublished = {arXiv preprint}\n}"


@pytest.mark.parametrize(("raw", "want"), [
    ('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Sure: {"a": [1,2,]} ok', '{"a": [1, 2]}'), ('{"a": "}"} tail', '{"a": "}"}'),
    ('[{"a": 1}]', '{"a": 1}'), ("{“a”: 1}", '{"a": 1}'), ("nothing", None), (None, None),
])
def test_json_repair(raw, want):
    assert jsonfix.repaired_json(raw) == want
