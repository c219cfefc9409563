"""Winnowing against all windows of both sides by definition."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from conftest import SF
from test_oracles import tidy

from citeweave.llm import decontamination, lookups
from citeweave.llm.registry import ORACLE_SQL, QUERIES
from citeweave.llm.textops import LETTERS, words_of

NONE = hashlib.sha256(b"").hexdigest()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_definition(docs, items, window=10):
    wanted = {}
    for key, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            wanted.setdefault(tuple(w[i : i + n]), set()).add("" if key is None else str(key))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wanted:
                    hit |= set(range(i, i + n))
                    found |= wanted[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def planted(seed, n_docs=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ÉTÉ", "x9"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, some(rng.choice([0, 1, 2, 4, 7, 9, 10, 11, 30]))) for i in range(12)]
    items += [(3, some(15)), (None, some(12)), (77, list(items[-1][1])), (78, list(items[-1][1]) + some(3))]
    docs = []
    for i in range(n_docs):
        w = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1]
            at, cut = rng.randrange(len(w) + 1), rng.randrange(len(own) + 1)
            w[at:at] = own[cut:] + own[:cut] if rng.random() < 0.5 else own
        text = rng.choice([" ", "\n", " - "]).join(x.upper() if rng.random() < 0.2 else x for x in w)
        docs.append((i if i % 9 else None, None if i == 5 else text))
    docs.append((10**6, " ".join(some(20_000) + items[-1][1])))
    return docs, [(k, " ".join(w)) for k, w in items] + [(99, None), (98, "!?")]


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, row string, n_words int")
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    return decontamination.decontaminate(d, i, **options)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_definition(spark, seed):
    docs, items = planted(seed)
    got, spans = run(spark, docs, items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_definition(docs, items)
    assert sum(r.words for r in spans.collect()) == sum(r[2] for r in by_definition(docs, items))


def test_hot_windows(spark, monkeypatch):
    """Keys that are hot and keys that are not, in one run; a passage that half of the rows hold."""
    monkeypatch.setattr(lookups, "HOT_SHARE", 20)
    docs, items = planted(4)
    docs += [(1000 + i, "before " + items[6][1] + f" after {i}" + items[-3][1]) for i in range(60)]
    got, _ = run(spark, docs, items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_definition(docs, items)


def test_other_windows(spark):
    docs, items = planted(5)
    for window in (1, 3, 6, 13):
        assert sorted((tuple(r) for r in run(spark, docs, items, window=window)[0].collect()), key=repr) == by_definition(docs, items, window)


def test_empty_sides(spark):
    docs, items = planted(6, 8)
    assert run(spark, [], items)[0].count() == 0
    for nothing in ([], [(1, None), (2, "")]):
        got = run(spark, docs, nothing)[0].collect()
        assert len(got) == len(docs) and {(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {(0, 0, NONE, False)}


def test_windows_keep_the_least_gram():
    """Of 10 words the fingerprint is the least of six 5-grams, wherever the window stands."""
    w = words_of([b"a b c d e f g h i j k l m n", b"q c d e f g h i j k l r"], LETTERS)
    at, prints = decontamination.fingerprints(w, 10)
    grams = decontamination.fingerprints(w, 10, 10)[0]
    assert at.tolist() == grams.tolist() == [0, 1, 2, 3, 4, 14, 15, 16]
    assert prints[2] == prints[6]  # "c" to "l" in both texts
    assert len(np.unique(prints)) < len(prints)


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLE_SQL["op11_decontamination"])
    got = QUERIES["op11_decontamination"](spark, SF).select([d[0] for d in found.description])
    assert tidy(map(tuple, got.collect())) == tidy(found.fetchall())
