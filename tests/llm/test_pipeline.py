"""The pipeline's stages and its run."""

import pytest
from conftest import SF

from citeweave.llm import secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        got = [r.doc_id for r in after.select("doc_id").collect()]
        assert set(got) <= ids and len(got) == len(set(got)), name
        before = spark.createDataFrame(after.collect(), docs.schema)
    assert before.count() > 0 and not any(secrets.base_spans(r.text) for r in before.collect())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert rows and max(fill.values()) <= 2048
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_odd_rows_are_accounted_for(spark):
    """Null and repeated keys, clashing names, null, empty and long texts: what each stage keeps of them."""
    import random

    rng = random.Random(3)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    one, two, three, long = fresh(60), fresh(70), fresh(80), fresh(200_000)
    rows = [(1, one), (1, two), (1, two), (2, two + " end"), (None, one), (None, one), (3, None), (3, ""), (4, " \n"), (5, three + "\n\npassword = hunter2hunter2"), (6, long), (7, long + " tail")]
    docs = spark.createDataFrame([(d, t, "en", "a", None if t is None else len(t), i, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row int, taken string, node int")
    kept = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        got = after.collect()
        kept = spark.createDataFrame(got, docs.schema)
        who = sorted(r.row for r in got)
        if i == 0:
            assert who == list(range(len(rows)))
        if i in (1, 2):  # (1, two) twice and (2, two + end) are one group; so are the long texts
            assert len(who) == 9 and {0, 4, 5, 6, 7, 8, 9, 10} < set(who) and len(set(who) & {1, 2}) == 1
        if i == 2:
            text = {r.row: r.text for r in got}
            assert text[9] == three + "\n\n[secret]" and text[0] == one and text[6] is None and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
        if i == 3:
            assert {0, 4, 5, 9, 10} <= set(who) and not set(who) & {6, 7, 8}
            assert all(r.n_chars == len(r.text) for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(got)


def test_near_duplicates_take_parts_by_the_texts_size(spark, monkeypatch):
    """A session with few shuffle partitions does not make tasks that grow with the input."""
    from citeweave.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "SHUFFLE_BYTES", 100)
    text = lambda k: " ".join(f"word{k}x{j}" for j in range(12))
    docs = spark.createDataFrame([(i, text(i // 2)) for i in range(10)] + [(None, "no key")], "doc_id long, text string")
    kept = jaccard_join.keep_one_per_group(docs, 5, 80)
    assert kept.rdd.getNumPartitions() >= 10
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in range(0, 10, 2)] + [(True, None)]
