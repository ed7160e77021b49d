"""The driver contract: entry(), queries(), oracle_sql() against DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001

TABLES = "region nation customer supplier part orders lineitem events".split()
QUICK = ["a1_sales_by_region", "a3_customer_segments", "a5_category_performance", "c21_cross_sell",
         "c26_rfm_segmentation", "d1_geo_drilldown", "f7_top_percent_customers", "m1_revenue_forecast",
         "m2_revenue_anomalies", "v8_dedupe_items", "c28_conversion_funnel", "c32_pivot_sales"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "orders", "units_sold", "revenue", "cost", "profit"]


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", QUICK)
def test_oracle_matches_at_sf0001(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = E.queries()[key](spark, SF001)
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _canon(df.columns, df.collect()) == _canon(ocols, res.fetchall())
