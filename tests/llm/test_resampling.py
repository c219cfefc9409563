"""Importance resampling against its definition in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF
from test_oracles import tidy

from citeweave.llm import lookups, resampling
from citeweave.llm.registry import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def by_definition(docs, target, percent=10, least=20, buckets=10_000, longest=1):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for _, text in rows for x in features(text, longest)[1]) for rows in (docs, target))
    size_s, size_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (size_s + buckets) / ((s[b] + 1.0) * (size_t + buckets))))
    rows = []
    for key, text in docs:
        n, found = features(text, longest)
        weight = sum(gain(bucket(x)) for x in found)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0]))
    k = percent * len(able) // 100
    out = [(*r[:4], i + 1 if i < k else None) for i, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Straße", "X9", "z" * 100, "中文"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    docs = [(i, text(rng.randrange(0, 50))) for i in range(n)]
    shared = text(40)
    docs += [(1000 + i, shared) for i in range(n // 2)] + [(None, text(30)), (2000, None), (2001, ""), (2002, " .,!"), (2003, text(30_000)), (5, text(33))]
    return docs, [(i, text(12)) for i in range(9)] + [(10, None)]


def run(spark, docs, target, **options):
    d = spark.createDataFrame([(*r, "c", 7) for r in docs], "doc_id long, text string, digest string, weight int")
    t = spark.createDataFrame([(*r, 1) for r in target], "item_id long, text string, copies int")
    return sorted((tuple(r) for r in resampling.resample(d, t, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"longest": 2}, {"longest": 3, "buckets": 97, "percent": 35, "least_words": 5}])
def test_equals_the_definition(spark, options):
    docs, target = corpus(1)
    names = {"least_words": "least"}
    assert run(spark, docs, target, **options) == by_definition(docs, target, **{names.get(k, k): v for k, v in options.items()})


def test_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_SHARE", 10)
    docs, target = corpus(2)
    assert run(spark, docs, target) == by_definition(docs, target)


def test_empty_sides(spark):
    docs, target = corpus(3, 30)
    assert run(spark, [], target) == []
    assert run(spark, docs, []) == by_definition(docs, [])
    assert [r[4] for r in run(spark, [(1, "few words"), (2, None)], target)] == [None, None]


def test_drawn_documents_keep_their_columns(spark):
    docs, target = corpus(4, 60)
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id long, text string, rank int")
    drawn = resampling.drawn_documents(d, spark.createDataFrame(target, "item_id long, text string"))
    keys = {r[0] for r in by_definition(docs, target) if r[4] is not None}
    assert drawn.columns == d.columns and sorted(r.rank for r in drawn.collect()) == [i for i, r in enumerate(docs) if r[0] in keys]


def test_crc_of_spans():
    rng = np.random.default_rng(5)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + rng.choice([0, 1, 2, 5, 63, 64, 65, 900], 300)
    assert resampling.crc32_spans(raw, start, end).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(start, end, strict=True)]


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL["op13_importance_resampling"])
    got = QUERIES["op13_importance_resampling"](spark, SF).select([d[0] for d in found.description])
    assert tidy(map(tuple, got.collect())) == tidy(found.fetchall())
