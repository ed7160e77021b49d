"""Golden results on the reference's sample rows (expected values: the
survey's FIXTURES §3, computed from the sample CSVs)."""

from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from tests.sample import sample_star
from tillroll.operators import joins, quality
from tillroll.plans import metrics as M
from tillroll.plans import sales


@pytest.fixture(scope="module")
def star(spark):
    return sample_star(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_row_counts(star):
    got = dict(rows(sales.row_counts({"orders": star.orders, "order_items": star.order_items,
                                      "customers": star.customers, "products": star.products})))
    assert got == {"orders": 10, "order_items": 16, "customers": 7, "products": 8}


def test_sales_by_region(star):
    got = rows(sales.sales_by_region(star.orders))
    assert [(r[0], r[1], r[2]) for r in got] == [
        ("us-east", 3, Dec("5018.80")), ("eu-west", 2, Dec("3230.00")),
        ("ap-southeast", 1, Dec("2100.00")), ("us-west", 2, Dec("1336.00"))]
    assert got[0][3] == pytest.approx(1672.933333, abs=1e-6)


def test_top_products(star):
    got = rows(sales.top_products(star.order_items, star.products, star.orders))
    assert got == [
        ("Ergonomic Keyboard", "Electronics", Dec("3900.0000"), 10),
        ("Laptop Pro 15", "Electronics", Dec("3112.5000"), 15),
        ("Office Chair Deluxe", "Furniture", Dec("1335.3750"), 2),
        ("Wireless Mouse", "Electronics", Dec("1200.0000"), 4),
        ("Standing Desk", "Furniture", Dec("1045.0000"), 4),
        ("USB-C Hub", "Electronics", Dec("945.0000"), 7),
        ("Monitor 27inch", "Electronics", Dec("315.0000"), 1)]


def test_customer_segments_drops_customers_without_completed_orders(star):
    got = rows(sales.customer_segments(star.customers, star.orders))
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [
        ("premium", 3, 5, Dec("7148.30")), ("enterprise", 1, 1, Dec("3200.50")),
        ("standard", 1, 2, Dec("1336.00"))]
    assert got[0][4] == pytest.approx(1429.66)


def test_customer_segments_keeps_customer_without_orders(spark, star):
    extra = spark.createDataFrame([("C999", "No Orders", "x@y", None, "newbie", "UK")], star.customers.schema)
    got = {r[0]: r for r in rows(sales.customer_segments(star.customers.unionByName(extra), star.orders))}
    assert got["newbie"][1:4] == (1, 0, None)
    assert got["newbie"][4] is None


def test_daily_sales(star):
    got = [(str(r[0]), r[1], r[2]) for r in rows(sales.daily_sales(star.orders))]
    assert got == [("2024-01-15", 3, Dec("4480.75")), ("2024-01-16", 2, Dec("3768.30")),
                   ("2024-01-17", 2, Dec("1335.75")), ("2024-01-18", 1, Dec("2100.00"))]


def test_category_performance(star):
    got = rows(sales.category_performance(star.order_items, star.products, star.orders))
    assert got == [("Electronics", 6, 37, Dec("9472.5000"), Dec("5260.00"), Dec("4212.5000")),
                   ("Furniture", 3, 6, Dec("2380.3750"), Dec("1700.00"), Dec("680.3750"))]


def test_segment_sales_inner(star):
    got = rows(sales.segment_sales_inner(star.orders, star.customers))
    assert got == [("premium", 5, Dec("7148.30")), ("enterprise", 1, Dec("3200.50")),
                   ("standard", 2, Dec("1336.00"))]


def test_profit_margin_literal_keeps_fan_out(star):
    ps = joins.product_sales(star.order_items, star.products, star.orders)
    r = M.profit_margin_literal(ps).first()
    assert r["fanned_total_amount"] == Dec("24959.40")
    assert r["cost"] == Dec("9160.00")
    assert r["profit_margin"] == pytest.approx(0.633004, abs=1e-6)


def test_profit_margin_pct_whole_set(star):
    ps = sales.completed_lines(star.order_items, star.products, star.orders)
    r = ps.agg(F.sum(F.col("line_amount") * (1 - F.col("discount"))).alias("revenue"),
               F.sum(F.col("quantity") * F.col("unit_cost")).alias("cost")).first()
    assert float((r["revenue"] - r["cost"]) / r["revenue"] * 100) == pytest.approx(41.2801, abs=1e-4)
    per_cat = {x[0]: x[3] for x in rows(M.profit_margin_pct(
        sales.category_performance(star.order_items, star.products, star.orders)))}
    assert per_cat["Electronics"] == pytest.approx(4212.5 / 9472.5 * 100)


def test_order_size_categories(star):
    got = {r[0]: r[1] for r in rows(M.order_size_distribution(star.orders))}
    assert got == {"Small": 1, "Medium": 4, "Large": 5}


def test_conversion_status_and_total(star):
    assert M.order_conversion_rate(star.orders).first()["conversion_rate_pct"] == 80.0
    got = {r[0]: r[1] for r in rows(M.status_distribution(star.orders))}
    assert got == {"completed": 8, "pending": 1, "cancelled": 1}
    assert M.kpi_total_revenue(star.orders).first()[0] == Dec("15142.70")


def test_reconcile_orders(star):
    got = {r["order_id"]: r["difference"] for r in quality.reconcile_orders(star.orders, star.order_items).collect()}
    expected = {1001: "-99.50", 1002: "0", 1003: "232.50", 1004: "-2.20", 1005: "0", 1006: "-399.50",
                1007: "0.625", 1008: "-162.10", 1009: "-100.00", 1010: "200.00"}
    assert {k: Dec(v) for k, v in expected.items()} == got


def test_cross_sell_pairs(spark, star):
    anchors = star.products.select("product_id")
    pairs = {tuple(sorted((r[0], r[1]))) for r in rows(joins.co_occurrence(star.order_items, anchors))}
    assert pairs == {("P101", "P102"), ("P101", "P104"), ("P101", "P107"), ("P102", "P105"),
                     ("P104", "P108"), ("P105", "P106")}
    counts = rows(joins.co_occurrence(star.order_items, anchors).select("pair_orders").distinct())
    assert counts == [(1,)]


def test_cross_sell_metrics(spark, star):
    anchors = spark.createDataFrame([("P101",)], "product_id string")
    got = {r["product_id"]: r for r in M.cross_sell(star.order_items, anchors).collect()}
    assert set(got) == {"P102", "P104", "P107"}
    # P101 is in 3 of 10 orders, P102 in 2: confidence 1/3, lift (1/3)/(2/10)
    assert got["P102"]["support"] == pytest.approx(0.1)
    assert got["P102"]["confidence"] == pytest.approx(1 / 3)
    assert got["P102"]["lift"] == pytest.approx((1 / 3) / 0.2)
