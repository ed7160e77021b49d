"""Empty inputs: every builder returns an empty frame or a one-row
aggregate of NULLs / zeros, never an error."""

from pyspark.sql import functions as F

from tests.sample import sample_star
from tillroll.operators import joins, quality, ranking
from tillroll.plans import drilldown, metrics as M, predict as P, sales
from tillroll.sources.testdata import Star


def _empty_star(spark):
    s = sample_star(spark)
    return Star(*(df.where(F.lit(False)) for df in (s.orders, s.order_items, s.customers, s.products)))


def test_named_queries_on_empty_tables(spark):
    e = _empty_star(spark)
    assert sales.sales_by_region(e.orders).count() == 0
    assert sales.top_products(e.order_items, e.products, e.orders).count() == 0
    assert sales.customer_segments(e.customers, e.orders).count() == 0
    assert sales.daily_sales(e.orders).count() == 0
    assert sales.category_performance(e.order_items, e.products, e.orders).count() == 0
    assert dict(sales.row_counts({"orders": e.orders}).collect()) == {"orders": 0}


def test_kpis_on_empty_tables(spark):
    e = _empty_star(spark)
    assert M.kpi_total_revenue(e.orders).first()[0] is None
    r = M.order_conversion_rate(e.orders).first()
    assert (r["completed_orders"], r["total_orders"], r["conversion_rate_pct"]) == (0, 0, None)
    assert M.revenue_per_customer(e.orders).first()["revenue_per_customer"] is None
    ps = joins.product_sales(e.order_items, e.products, e.orders)
    assert M.profit_margin_literal(ps).first()["profit_margin"] is None
    assert drilldown.geo_drilldown(joins.orders_with_customers(e.orders, e.customers)).count() <= 1


def test_ranking_and_pairs_on_empty_input(spark):
    e = _empty_star(spark)
    df = spark.createDataFrame([], "customer_id long, revenue double")
    assert ranking.top_percent(df, "revenue", 0.2, ["customer_id"]).count() == 0
    assert ranking.ntile_global(df, [F.col("revenue")], 5, "q").count() == 0
    assert M.cross_sell(e.order_items, e.products.select("product_id")).count() == 0
    assert quality.dedupe(e.order_items, ["order_id", "product_id"], ["quantity"]).count() == 0


def test_forecasts_on_empty_input(spark):
    e = _empty_star(spark)
    assert P.revenue_forecast(e.orders).count() == 0
    assert P.revenue_anomalies(e.orders).count() == 0
