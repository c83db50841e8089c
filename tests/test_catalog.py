"""Each catalog query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from quartzline.functions import scalars
from quartzline.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)
    assert rows
    if name in catalog.ORACLES:
        res = db.execute(catalog.ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        want = sorted((tuple(r[names.index(c)] for c in cols) for r in res.fetchall()), key=str)
        assert len(rows) == len(want)
        bad = [(g, w) for g, w in zip(rows, want, strict=True) if not all(map(same, g, w))]
        assert not bad, bad[:3]


def test_fuzzy_top1_is_the_best_of_all_names(spark, db):
    names = sorted(r[0] for r in db.execute("SELECT DISTINCT p_name FROM part").fetchall())
    got = {r.name: (r.best, r.score) for r in catalog.q_fuzzy_top1(spark, SF).collect()}
    want = {}
    for a in names:
        score, best = max(((scalars.token_sort(a, b), b) for b in names if b != a), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        want[a] = (best, round(score, 6))
    assert got.keys() == want.keys()
    assert all(got[a][0] == want[a][0] and math.isclose(got[a][1], want[a][1], abs_tol=1e-6) for a in names)
    assert any(a[0] != best[0] for a, (best, _) in got.items())
