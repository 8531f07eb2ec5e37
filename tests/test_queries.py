"""Every registered query of the reference's operators against its SQL, and the others for rows."""

import math
import os

import pytest

from conftest import SF
from kinegrain.plans import catalogue
from kinegrain.plans.views import TABLES

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set enable_progress_bar=false")
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.8g}")
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE:
        assert rows
        return
    result = duck.execute(catalogue.ORACLE[name])
    cols = [d[0] for d in result.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[cols.index(c)]) for c in sorted(cols))) for r in result.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(cols))) for r in rows) == want


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1
    assert os.path.exists(os.path.join(os.path.dirname(e.__file__), "bench.py"))
