"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from conftest import SF

from citeweave.plans.oracles import ORACLES
from citeweave.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def tidy(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = REGISTRY[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in found.fetchall()]
    assert tidy(tuple(r[c] for c in cols) for r in df.collect()) == tidy(want)


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(ORACLES)))
def test_rows_only(spark, name):
    assert REGISTRY[name](spark, SF).count() > 0
