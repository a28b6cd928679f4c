"""Every registered query of the grid against its SQL twin, on the small tables."""

import os

import pandas
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
GRID = [n for n, q in entry.queries().items() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def sql():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(frame):
    text = lambda v: "" if v is None or v is pandas.NA or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)
    return sorted("|".join(text(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", GRID)
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    twin = entry.oracle_sql().get(name)
    if twin is None:
        assert len(got.columns)
        return
    assert _rows(got) == _rows(sql.execute(twin).df())
