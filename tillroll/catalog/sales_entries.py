"""Catalog: named sales queries A1-A8, joins J1-J6, sorts O1-O3, union U1."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.catalog.common import oracle, out
from tillroll.plans import sales
from tillroll.sources import testdata as td


def _a1(spark, sf):
    return out(sales.sales_by_region(td.orders(spark, sf)))


A1_SQL = oracle("""
SELECT region, COUNT(DISTINCT order_id) AS total_orders,
       CAST(SUM(total_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(total_amount) AS DOUBLE) / COUNT(total_amount) AS avg_order_value
FROM star_orders WHERE status = 'completed'
GROUP BY region ORDER BY total_revenue DESC""")


def _a2(spark, sf):
    return out(sales.top_products(td.order_items(spark, sf), td.products(spark, sf),
                                  td.orders_plain(spark, sf)))


A2_SQL = oracle("""
SELECT p.product_name, p.category,
       CAST(SUM(oi.line_amount * (1 - oi.discount)) AS DOUBLE) AS revenue,
       CAST(SUM(oi.quantity) AS BIGINT) AS units_sold
FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
JOIN star_orders_plain o ON oi.order_id = o.order_id
WHERE o.status = 'completed'
GROUP BY p.product_name, p.category
ORDER BY SUM(oi.line_amount * (1 - oi.discount)) DESC, p.product_name, p.category
LIMIT 10""")


def _a3(spark, sf):
    return out(sales.customer_segments(td.customers(spark, sf), td.orders_plain(spark, sf)))


A3_SQL = oracle("""
SELECT c.customer_segment,
       COUNT(DISTINCT c.customer_id) AS customer_count,
       COUNT(DISTINCT o.order_id) AS total_orders,
       CAST(SUM(o.total_amount) AS DOUBLE) AS total_revenue,
       CAST(SUM(o.total_amount) AS DOUBLE) / COUNT(o.total_amount) AS avg_order_value
FROM star_customers c LEFT JOIN star_orders_plain o ON c.customer_id = o.customer_id
WHERE o.status = 'completed' OR o.status IS NULL
GROUP BY c.customer_segment ORDER BY total_revenue DESC""")


def _a4(spark, sf):
    return out(sales.daily_sales(td.orders_plain(spark, sf)))


A4_SQL = oracle("""
SELECT CAST(order_date AS DATE) AS order_date, COUNT(DISTINCT order_id) AS orders,
       CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain WHERE status = 'completed'
GROUP BY CAST(order_date AS DATE) ORDER BY 1""")


def _a5(spark, sf):
    return out(sales.category_performance(td.order_items(spark, sf), td.products(spark, sf),
                                          td.orders_plain(spark, sf)))


A5_SQL = oracle("""
SELECT p.category, COUNT(DISTINCT oi.order_id) AS orders, CAST(SUM(oi.quantity) AS BIGINT) AS units_sold,
       CAST(SUM(oi.line_amount * (1 - oi.discount)) AS DOUBLE) AS revenue,
       CAST(SUM(oi.quantity * p.unit_cost) AS DOUBLE) AS cost,
       CAST(SUM(oi.line_amount * (1 - oi.discount)) - SUM(oi.quantity * p.unit_cost) AS DOUBLE) AS profit
FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
JOIN star_orders_plain o ON oi.order_id = o.order_id
WHERE o.status = 'completed'
GROUP BY p.category ORDER BY revenue DESC""")


def _a6(spark, sf):
    return out(sales.segment_sales_inner(td.orders_plain(spark, sf), td.customers(spark, sf)))


A6_SQL = oracle("""
SELECT c.customer_segment, COUNT(DISTINCT o.order_id) AS total_orders,
       CAST(SUM(o.total_amount) AS DOUBLE) AS total_revenue
FROM star_orders_plain o JOIN star_customers c ON o.customer_id = c.customer_id
WHERE o.status = 'completed'
GROUP BY c.customer_segment ORDER BY total_revenue DESC""")


def _a7(spark, sf):
    return sales.row_counts({
        "orders": td.orders_plain(spark, sf), "order_items": td.order_items(spark, sf),
        "customers": td.table(spark, sf, "customer"), "products": td.products(spark, sf)})


A7_SQL = oracle("""
SELECT 'orders' AS table_name, COUNT(*) AS row_count FROM star_orders_plain
UNION ALL SELECT 'order_items', COUNT(*) FROM star_items
UNION ALL SELECT 'customers', COUNT(*) FROM star_customers
UNION ALL SELECT 'products', COUNT(*) FROM star_products""")


def _a8(table_fn, alias):
    return lambda spark, sf: sales.count_rows(table_fn(spark, sf), alias)


def _j1(spark, sf):
    """J1 row level: items JOIN products."""
    oi = td.order_items(spark, sf)
    return out(oi.join(td.products(spark, sf), "product_id")
               .select("order_id", "line_number", "product_id", "category", "unit_cost"))


J1_SQL = oracle("""
SELECT oi.order_id, CAST(oi.line_number AS BIGINT) AS line_number, oi.product_id, p.category, CAST(p.unit_cost AS DOUBLE) AS unit_cost
FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id""")


def _j2(spark, sf):
    """J2 row level: items JOIN orders."""
    return (td.order_items(spark, sf)
            .join(td.orders_plain(spark, sf), "order_id")
            .select("order_id", "line_number", "status", F.to_date("order_date").alias("order_day")))


J2_SQL = oracle("""
SELECT oi.order_id, oi.line_number, o.status, CAST(o.order_date AS DATE) AS order_day
FROM star_items oi JOIN star_orders_plain o ON oi.order_id = o.order_id""")


def _j3(spark, sf):
    """J3 row level: customers LEFT JOIN orders."""
    return sales.customers_left_orders(td.customers(spark, sf).select("customer_id", "customer_segment"),
                                       td.orders_plain(spark, sf).select("customer_id", "order_id", "status"))


J3_SQL = oracle("""
SELECT c.customer_id, c.customer_segment, o.order_id, o.status
FROM star_customers c LEFT JOIN star_orders_plain o ON c.customer_id = o.customer_id""")


def _j4(spark, sf):
    """J4 row level: orders JOIN customers."""
    return (td.orders_plain(spark, sf).select("order_id", "customer_id")
            .join(td.customers(spark, sf).select("customer_id", "customer_segment", "country"),
                  "customer_id"))


J4_SQL = oracle("""
SELECT o.customer_id, o.order_id, c.customer_segment, c.country
FROM star_orders_plain o JOIN star_customers c ON o.customer_id = c.customer_id""")


ENTRIES = {
    "a1_sales_by_region": (_a1, A1_SQL),
    "a2_top_products": (_a2, A2_SQL),
    "a3_customer_segments": (_a3, A3_SQL),
    "a4_daily_sales": (_a4, A4_SQL),
    "a5_category_performance": (_a5, A5_SQL),
    "a6_segment_sales_inner": (_a6, A6_SQL),
    "a7_row_counts": (_a7, A7_SQL),
    "a8_order_count": (_a8(td.orders_plain, "order_count"),
                       oracle("SELECT COUNT(*) AS order_count FROM star_orders_plain")),
    "a8_order_item_count": (_a8(td.order_items, "order_item_count"),
                            oracle("SELECT COUNT(*) AS order_item_count FROM star_items")),
    "a8_customer_count": (_a8(lambda spark, sf: td.table(spark, sf, "customer"), "customer_count"),
                          oracle("SELECT COUNT(*) AS customer_count FROM star_customers")),
    "a8_product_count": (_a8(td.products, "product_count"),
                         oracle("SELECT COUNT(*) AS product_count FROM star_products")),
    "j1_items_products": (_j1, J1_SQL),
    "j2_items_orders": (_j2, J2_SQL),
    "j3_customers_left_orders": (_j3, J3_SQL),
    "j4_orders_customers": (_j4, J4_SQL),
}
