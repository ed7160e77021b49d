"""Catalog: BI metrics C1-C33, joined datasets J5-J7, drill-downs D1-D3,
scalar functions K1-K10."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.catalog.common import oracle, out
from tillroll.functions import columns as K
from tillroll.operators import joins
from tillroll.plans import drilldown, metrics as M, sales
from tillroll.sources import testdata as td

AS_OF_SQL = "(SELECT MAX(CAST(order_date AS DATE)) FROM star_orders_plain)"


def _ps(spark, sf, with_region=False):
    o = td.orders(spark, sf) if with_region else td.orders_plain(spark, sf)
    return joins.product_sales(td.order_items(spark, sf), td.products(spark, sf), o)


PS_SQL = """star_ps AS (
  SELECT oi.*, p.product_name, p.category, p.subcategory, p.unit_cost,
         o.customer_id, o.order_date, o.total_amount, o.status
  FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
  JOIN star_orders_plain o ON oi.order_id = o.order_id)"""


def _c1(spark, sf):
    return out(M.profit_margin_literal(_ps(spark, sf)))


C1_SQL = oracle("""
SELECT CAST(SUM(total_amount) AS DOUBLE) AS fanned_total_amount,
       CAST(SUM(quantity * unit_cost) AS DOUBLE) AS cost,
       CAST(SUM(total_amount) - SUM(quantity * unit_cost) AS DOUBLE)
         / NULLIF(CAST(SUM(total_amount) AS DOUBLE), 0) AS profit_margin
FROM star_ps""", PS_SQL)


def _c2(spark, sf):
    cp = sales.category_performance(td.order_items(spark, sf), td.products(spark, sf),
                                    td.orders_plain(spark, sf))
    return out(M.profit_margin_pct(cp))


C2_SQL = oracle("""
SELECT category, CAST(SUM(line_amount * (1 - discount)) AS DOUBLE) AS revenue,
       CAST(SUM(quantity * unit_cost) AS DOUBLE) AS cost,
       CAST(SUM(line_amount * (1 - discount)) - SUM(quantity * unit_cost) AS DOUBLE)
         / NULLIF(CAST(SUM(line_amount * (1 - discount)) AS DOUBLE), 0) * 100.0 AS profit_margin_pct
FROM star_ps WHERE status = 'completed' GROUP BY category""", PS_SQL)


def _c3(spark, sf):
    return out(M.order_size_distribution(td.orders_plain(spark, sf)))


C3_SQL = oracle("""
SELECT CASE WHEN total_amount < 500 THEN 'Small' WHEN total_amount < 1500 THEN 'Medium'
            ELSE 'Large' END AS order_size_category,
       COUNT(*) AS orders, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain GROUP BY 1""")


def _c4(spark, sf):
    o = td.orders_plain(spark, sf)
    return M.with_days_since_order(o, M.latest_order_day(o)).select("order_id", "days_since_order")


C4_SQL = oracle(f"""
SELECT order_id, CAST(date_diff('day', CAST(order_date AS DATE), {AS_OF_SQL}) AS BIGINT) AS days_since_order
FROM star_orders_plain""")


def _c5(spark, sf):
    return out(M.revenue_per_customer(td.orders_plain(spark, sf)))


C5_SQL = oracle("""
SELECT CAST(SUM(total_amount) AS DOUBLE) AS total_revenue, COUNT(DISTINCT customer_id) AS customers,
       CAST(SUM(total_amount) AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT customer_id) AS DOUBLE), 0) AS revenue_per_customer
FROM star_orders_plain WHERE status = 'completed'""")


def _c6(spark, sf):
    return out(M.order_conversion_rate(td.orders_plain(spark, sf)))


C6_SQL = oracle("""
SELECT COUNT(*) FILTER (WHERE status = 'completed') AS completed_orders, COUNT(*) AS total_orders,
       CAST(COUNT(*) FILTER (WHERE status = 'completed') AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) * 100.0
         AS conversion_rate_pct
FROM star_orders_plain""")


def _c7(spark, sf):
    return out(M.yoy_growth(td.orders_plain(spark, sf)))


C7_SQL = oracle("""
SELECT y.year, CAST(y.revenue AS DOUBLE) AS revenue, CAST(p.revenue AS DOUBLE) AS prev_revenue,
       CAST(y.revenue - p.revenue AS DOUBLE) AS yoy_change,
       CAST(y.revenue - p.revenue AS DOUBLE) / NULLIF(CAST(p.revenue AS DOUBLE), 0) * 100.0 AS yoy_growth_pct
FROM yr y LEFT JOIN yr p ON p.year = y.year - 1""", """yr AS (
  SELECT CAST(year(order_date) AS BIGINT) AS year, SUM(total_amount) AS revenue
  FROM star_orders_plain WHERE status = 'completed' GROUP BY 1)""")


def _c8(spark, sf):
    return out(M.mom_comparison(td.orders_plain(spark, sf)))


C8_SQL = oracle("""
SELECT m.month, CAST(m.revenue AS DOUBLE) AS revenue, CAST(p.revenue AS DOUBLE) AS prev_revenue,
       CAST(m.revenue - p.revenue AS DOUBLE) AS mom_change,
       CAST(m.revenue - p.revenue AS DOUBLE) / NULLIF(CAST(p.revenue AS DOUBLE), 0) * 100.0 AS mom_growth_pct
FROM mo m LEFT JOIN mo p ON p.month = CAST(m.month - INTERVAL 1 MONTH AS DATE)""", """mo AS (
  SELECT CAST(date_trunc('month', CAST(order_date AS DATE)) AS DATE) AS month, SUM(total_amount) AS revenue
  FROM star_orders_plain WHERE status = 'completed' GROUP BY 1)""")


def _c9_segment(spark, sf):
    return out(M.segment_share(td.orders_plain(spark, sf), td.customers(spark, sf)))


C9S_SQL = oracle("""
SELECT customer_segment, CAST(revenue AS DOUBLE) AS revenue,
       CAST(revenue AS DOUBLE) / NULLIF(CAST(SUM(revenue) OVER () AS DOUBLE), 0) * 100.0 AS share_pct
FROM (SELECT c.customer_segment, SUM(o.total_amount) AS revenue
      FROM star_orders_plain o JOIN star_customers c ON o.customer_id = c.customer_id
      WHERE o.status = 'completed' GROUP BY 1) s""")


def _c9_category(spark, sf):
    return out(M.category_share(td.order_items(spark, sf), td.products(spark, sf),
                                td.orders_plain(spark, sf)))


C9C_SQL = oracle("""
SELECT category, CAST(revenue AS DOUBLE) AS revenue,
       CAST(revenue AS DOUBLE) / NULLIF(CAST(SUM(revenue) OVER () AS DOUBLE), 0) * 100.0 AS share_pct
FROM (SELECT category, SUM(line_amount * (1 - discount)) AS revenue
      FROM star_ps WHERE status = 'completed' GROUP BY 1) s""", PS_SQL)


def _c10(spark, sf):
    return out(M.status_distribution(td.orders_plain(spark, sf)))


C10_SQL = oracle("""
SELECT status, orders, CAST(orders AS DOUBLE) / NULLIF(CAST(SUM(orders) OVER () AS DOUBLE), 0) * 100.0 AS pct_of_orders
FROM (SELECT status, COUNT(DISTINCT order_id) AS orders FROM star_orders_plain GROUP BY 1) s""")


def _c11(spark, sf):
    return out(M.kpi_total_revenue(td.orders_plain(spark, sf)))


C11_SQL = oracle("SELECT CAST(SUM(total_amount) AS DOUBLE) AS total_revenue FROM star_orders_plain")


def _c12(spark, sf):
    o = td.orders_plain(spark, sf)
    return out(M.executive_kpis(o, M.latest_order_day(o)))


C12_SQL = oracle(f"""
SELECT CAST(SUM(total_amount) AS DOUBLE) AS revenue, COUNT(DISTINCT order_id) AS orders,
       COUNT(DISTINCT customer_id) AS customers,
       CAST(SUM(total_amount) AS DOUBLE) / NULLIF(CAST(COUNT(total_amount) AS DOUBLE), 0) AS avg_order_value
FROM star_orders_plain
WHERE status = 'completed'
  AND CAST(order_date AS DATE) >= CAST(date_trunc('month', {AS_OF_SQL}) AS DATE)
  AND CAST(order_date AS DATE) <= {AS_OF_SQL}""")


def _c13(spark, sf):
    r = M.product_kpis(_ps(spark, sf))
    return out(r.withColumn("avg_profit_margin_pct", F.round("avg_profit_margin_pct", 6)))


C13_SQL = oracle("""
SELECT CAST(SUM(units) AS BIGINT) AS units_sold, COUNT(*) AS products_sold, CAST(SUM(revenue) AS DOUBLE) AS revenue,
       ROUND(AVG(CAST(revenue - cost AS DOUBLE) / NULLIF(CAST(revenue AS DOUBLE), 0) * 100.0), 6) AS avg_profit_margin_pct
FROM (SELECT product_id, SUM(quantity) AS units, SUM(line_amount * (1 - discount)) AS revenue,
             SUM(quantity * unit_cost) AS cost
      FROM star_ps WHERE status = 'completed' GROUP BY 1) s""", PS_SQL)


def _c14(spark, sf):
    return out(M.customer_kpis(td.orders_plain(spark, sf), td.customers(spark, sf)))


C14_SQL = oracle("""
SELECT (SELECT COUNT(*) FROM star_customers) AS total_customers,
       COUNT(DISTINCT customer_id) AS buying_customers,
       CAST(SUM(total_amount) AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT customer_id) AS DOUBLE), 0) AS revenue_per_customer,
       CAST(COUNT(DISTINCT order_id) AS DOUBLE) / NULLIF(CAST(COUNT(DISTINCT customer_id) AS DOUBLE), 0) AS orders_per_customer
FROM star_orders_plain WHERE status = 'completed'""")


def _c15(spark, sf):
    return out(M.region_total_sales(td.orders(spark, sf)))


C15_SQL = oracle("""
SELECT region, CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM star_orders
GROUP BY region ORDER BY revenue DESC""")


def _c16(spark, sf):
    return out(M.revenue_trend(td.orders_plain(spark, sf)))


C16_SQL = oracle("""
SELECT CAST(order_date AS DATE) AS order_date, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain GROUP BY 1 ORDER BY 1""")


def _c17(spark, sf):
    return out(M.top_products_by_header_total(_ps(spark, sf)))


C17_SQL = oracle("""
SELECT product_name, CAST(SUM(quantity) AS BIGINT) AS units_sold, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_ps GROUP BY product_name ORDER BY SUM(total_amount) DESC, product_name LIMIT 10""", PS_SQL)


def _c18(spark, sf):
    return out(M.product_details(_ps(spark, sf)))


C18_SQL = oracle("""
SELECT product_id, product_name, category,
       CAST(SUM(line_amount * (1 - discount)) AS DOUBLE) AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold,
       CAST(SUM(quantity * unit_cost) AS DOUBLE) AS cost,
       CAST(SUM(line_amount * (1 - discount)) - SUM(quantity * unit_cost) AS DOUBLE) AS profit
FROM star_ps WHERE status = 'completed' GROUP BY 1, 2, 3""", PS_SQL)


def _c19_category(spark, sf):
    return out(M.category_trend(_ps(spark, sf)))


C19C_SQL = oracle("""
SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS period,
       CAST(SUM(line_amount * (1 - discount)) AS DOUBLE) AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold
FROM star_ps WHERE status = 'completed' GROUP BY 1, 2""", PS_SQL)


def _c19_product(spark, sf):
    return out(M.product_trend(_ps(spark, sf)))


C19P_SQL = oracle("""
SELECT product_id, CAST(date_trunc('month', order_date) AS DATE) AS period,
       CAST(SUM(line_amount * (1 - discount)) AS DOUBLE) AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold
FROM star_ps WHERE status = 'completed' GROUP BY 1, 2""", PS_SQL)


def _c20(spark, sf):
    return out(M.periodic_sales(td.orders_plain(spark, sf)))


C20_SQL = oracle("\nUNION ALL\n".join(f"""
SELECT '{g}' AS grain, CAST(date_trunc('{g}', CAST(order_date AS DATE)) AS DATE) AS period,
       COUNT(DISTINCT order_id) AS orders, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain WHERE status = 'completed' GROUP BY 1, 2""" for g in M.GRAINS))


def _anchor_items(spark, sf):
    items = td.order_items(spark, sf)
    return items, M.best_selling_product(items)


def _c21(spark, sf):
    items, anchors = _anchor_items(spark, sf)
    return out(M.cross_sell(items, anchors))


BASKET_SQL = """bk AS (SELECT DISTINCT order_id, product_id FROM star_items),
bk_prod AS (SELECT product_id, COUNT(*) AS product_orders FROM bk GROUP BY 1),
bk_anchor AS (SELECT product_id AS anchor_id FROM bk_prod ORDER BY product_orders DESC, product_id LIMIT 1),
bk_pairs AS (
  SELECT a.product_id AS anchor_id, b.product_id, COUNT(*) AS pair_orders
  FROM bk a JOIN bk b ON a.order_id = b.order_id AND a.product_id <> b.product_id
  WHERE a.product_id IN (SELECT anchor_id FROM bk_anchor)
  GROUP BY 1, 2)"""

C21_SQL = oracle("""
SELECT p.anchor_id, p.product_id, p.pair_orders,
       CAST(p.pair_orders AS DOUBLE) / NULLIF(CAST((SELECT COUNT(DISTINCT order_id) FROM bk) AS DOUBLE), 0) AS support,
       CAST(p.pair_orders AS DOUBLE) / NULLIF(CAST(a.product_orders AS DOUBLE), 0) AS confidence,
       (CAST(p.pair_orders AS DOUBLE) / NULLIF(CAST(a.product_orders AS DOUBLE), 0))
         / NULLIF(CAST(b.product_orders AS DOUBLE)
                  / NULLIF(CAST((SELECT COUNT(DISTINCT order_id) FROM bk) AS DOUBLE), 0), 0) AS lift
FROM bk_pairs p JOIN bk_prod a ON a.product_id = p.anchor_id
JOIN bk_prod b ON b.product_id = p.product_id""", BASKET_SQL)


def _j7(spark, sf):
    items, anchors = _anchor_items(spark, sf)
    return joins.co_occurrence(items, anchors)


J7_SQL = oracle("SELECT anchor_id, product_id, pair_orders FROM bk_pairs", BASKET_SQL)


def _c22(spark, sf):
    return out(M.customer_lifetime_value(td.orders_plain(spark, sf)))


C22_SQL = oracle("""
SELECT customer_id, CAST(SUM(total_amount) AS DOUBLE) AS lifetime_revenue,
       COUNT(DISTINCT order_id) AS orders,
       MIN(CAST(order_date AS DATE)) AS first_order, MAX(CAST(order_date AS DATE)) AS last_order,
       CAST(date_diff('day', MIN(CAST(order_date AS DATE)), MAX(CAST(order_date AS DATE))) AS BIGINT) AS tenure_days
FROM star_orders_plain WHERE status = 'completed' GROUP BY 1""")


def _c23(spark, sf):
    return M.order_frequency_distribution(td.customers(spark, sf), td.orders_plain(spark, sf))


C23_SQL = oracle("""
SELECT CAST(COALESCE(n, 0) AS BIGINT) AS orders_per_customer, COUNT(*) AS customers
FROM star_customers c LEFT JOIN (
  SELECT customer_id, COUNT(DISTINCT order_id) AS n FROM star_orders_plain
  WHERE status = 'completed' GROUP BY 1) o ON c.customer_id = o.customer_id
GROUP BY 1""")


def _c24(spark, sf):
    return M.customer_acquisition(M.signup_dates(td.orders_plain(spark, sf)))


C24_SQL = oracle("""
SELECT signup_month, new_customers,
       CAST(SUM(new_customers) OVER (ORDER BY signup_month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS BIGINT) AS cumulative_customers
FROM (SELECT CAST(date_trunc('month', signup_date) AS DATE) AS signup_month, COUNT(*) AS new_customers
      FROM (SELECT customer_id, MIN(CAST(order_date AS DATE)) AS signup_date
            FROM star_orders_plain GROUP BY 1) s GROUP BY 1) m""")

CHURN_DAYS = 365


def _c25(spark, sf):
    o = td.orders_plain(spark, sf)
    return out(M.churn(td.customers(spark, sf), o, M.latest_order_day(o), CHURN_DAYS))


C25_SQL = oracle(f"""
SELECT customer_segment, COUNT(*) AS customers, COUNT(*) FILTER (WHERE churned) AS churned,
       CAST(COUNT(*) FILTER (WHERE churned) AS DOUBLE) / NULLIF(CAST(COUNT(*) AS DOUBLE), 0) * 100.0 AS churn_rate_pct
FROM (SELECT c.customer_segment,
             (l.last_order IS NULL OR l.last_order <= {AS_OF_SQL} - INTERVAL {CHURN_DAYS} DAY) AS churned
      FROM star_customers c LEFT JOIN (
        SELECT customer_id, MAX(CAST(order_date AS DATE)) AS last_order FROM star_orders_plain
        WHERE status = 'completed' GROUP BY 1) l ON c.customer_id = l.customer_id) f
GROUP BY 1""")


def _c26(spark, sf):
    o = td.orders_plain(spark, sf)
    return out(M.rfm_segmentation(o, td.customers(spark, sf), M.latest_order_day(o)))


C26_SQL = oracle(f"""
SELECT r.customer_id, r.frequency, CAST(r.monetary AS DOUBLE) AS monetary, r.recency_days,
       NTILE(5) OVER (ORDER BY r.recency_days DESC, r.customer_id DESC) AS r_score,
       NTILE(5) OVER (ORDER BY r.frequency, r.customer_id) AS f_score,
       NTILE(5) OVER (ORDER BY r.monetary, r.customer_id) AS m_score,
       c.customer_segment
FROM (SELECT customer_id, COUNT(DISTINCT order_id) AS frequency, SUM(total_amount) AS monetary,
             CAST(date_diff('day', MAX(CAST(order_date AS DATE)), {AS_OF_SQL}) AS BIGINT) AS recency_days
      FROM star_orders_plain WHERE status = 'completed' GROUP BY 1) r
LEFT JOIN star_customers c ON r.customer_id = c.customer_id""")


def _c27(spark, sf):
    return out(M.geo_distribution(td.customers(spark, sf), td.orders_plain(spark, sf)))


C27_SQL = oracle("""
SELECT c.region, c.country, COUNT(DISTINCT o.customer_id) AS customers,
       COUNT(DISTINCT o.order_id) AS orders, CAST(SUM(o.total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain o JOIN star_customers c ON o.customer_id = c.customer_id
WHERE o.status = 'completed' GROUP BY 1, 2""")


def _c28(spark, sf):
    return M.conversion_funnel(td.events(spark, sf))


C28_SQL = """
WITH f AS (
  SELECT user_id,
         MIN(CASE WHEN event_type = 'signup' THEN ts END) AS t0,
         MIN(CASE WHEN event_type = 'view' THEN ts END) AS t1,
         MIN(CASE WHEN event_type = 'click' THEN ts END) AS t2,
         MIN(CASE WHEN event_type = 'purchase' THEN ts END) AS t3
  FROM events GROUP BY 1),
c AS (
  SELECT COUNT(*) FILTER (WHERE t0 IS NOT NULL) AS s0,
         COUNT(*) FILTER (WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND t1 >= t0) AS s1,
         COUNT(*) FILTER (WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND t1 >= t0
                          AND t2 IS NOT NULL AND t2 >= t1) AS s2,
         COUNT(*) FILTER (WHERE t0 IS NOT NULL AND t1 IS NOT NULL AND t1 >= t0
                          AND t2 IS NOT NULL AND t2 >= t1 AND t3 IS NOT NULL AND t3 >= t2) AS s3
  FROM f),
s AS (
  SELECT 1 AS step, 'signup' AS stage, s0 AS users, s0 AS prev, s0 AS first FROM c
  UNION ALL SELECT 2, 'view', s1, s0, s0 FROM c
  UNION ALL SELECT 3, 'click', s2, s1, s0 FROM c
  UNION ALL SELECT 4, 'purchase', s3, s2, s0 FROM c)
SELECT CAST(step AS BIGINT) AS step, stage, users,
       CAST(users AS DOUBLE) / NULLIF(CAST(prev AS DOUBLE), 0) * 100.0 AS step_rate_pct,
       CAST(users AS DOUBLE) / NULLIF(CAST(first AS DOUBLE), 0) * 100.0 AS overall_rate_pct
FROM s"""


def _c29(spark, sf):
    actual, targets = M.region_year_targets(td.orders(spark, sf))
    return out(M.target_status(actual, targets, ["region", "year"], "revenue"))


C29_SQL = oracle("""
SELECT a.region, a.year, CAST(a.revenue AS DOUBLE) AS revenue, CAST(t.revenue AS DOUBLE) AS target,
       CASE WHEN t.revenue IS NULL THEN NULL
            WHEN CAST(a.revenue AS DOUBLE) / NULLIF(CAST(t.revenue AS DOUBLE), 0) >= 1.0 THEN 'above'
            WHEN CAST(a.revenue AS DOUBLE) / NULLIF(CAST(t.revenue AS DOUBLE), 0) >= 0.9 THEN 'near'
            ELSE 'below' END AS target_status
FROM ry a LEFT JOIN ry t ON t.region = a.region AND t.year + 1 = a.year""", """ry AS (
  SELECT region, CAST(year(order_date) AS BIGINT) AS year, SUM(total_amount) AS revenue
  FROM star_orders WHERE status = 'completed' GROUP BY 1, 2)""")


def _c30(spark, sf):
    per_product = M.product_details(_ps(spark, sf)).select("product_id", "revenue")
    return out(M.color_scale(per_product, "revenue"))


C30_SQL = oracle("""
SELECT product_id, CAST(revenue AS DOUBLE) AS revenue,
       CAST(revenue - MIN(revenue) OVER () AS DOUBLE)
         / NULLIF(CAST(MAX(revenue) OVER () - MIN(revenue) OVER () AS DOUBLE), 0) AS color_scale
FROM (SELECT product_id, SUM(line_amount * (1 - discount)) AS revenue
      FROM star_ps WHERE status = 'completed' GROUP BY 1) s""", PS_SQL)

ALERT_THRESHOLD = 1000000


def _c31(spark, sf):
    return out(M.metric_alerts(td.orders(spark, sf), ALERT_THRESHOLD))


C31_SQL = oracle(f"""
SELECT region, CAST(order_date AS DATE) AS order_date, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_orders WHERE status = 'completed' GROUP BY 1, 2
HAVING SUM(total_amount) >= {ALERT_THRESHOLD}""")


def _c32(spark, sf):
    return out(M.pivot_sales(td.orders(spark, sf)))


C32_SQL = oracle("""
SELECT region,
       CAST(SUM(total_amount) FILTER (WHERE status = 'completed') AS DOUBLE) AS completed,
       CAST(SUM(total_amount) FILTER (WHERE status = 'pending') AS DOUBLE) AS pending,
       CAST(SUM(total_amount) FILTER (WHERE status = 'cancelled') AS DOUBLE) AS cancelled
FROM star_orders GROUP BY region""")


def _c33(spark, sf):
    return out(M.heatmap_feed(td.orders(spark, sf)))


C33_SQL = oracle("""
SELECT CAST(isodow(order_date) AS BIGINT) AS weekday, region,
       CAST(SUM(total_amount) AS DOUBLE) AS revenue, COUNT(DISTINCT order_id) AS orders
FROM star_orders WHERE status = 'completed' GROUP BY 1, 2""")


def _j5(spark, sf):
    return (joins.orders_with_customers(td.orders(spark, sf), td.customers(spark, sf))
            .select("order_id", "customer_id", "region", "customer_segment", "country"))


J5_SQL = oracle("""
SELECT o.order_id, o.customer_id, o.region, c.customer_segment, c.country
FROM star_orders o LEFT JOIN star_customers c ON o.customer_id = c.customer_id""")


def _j6(spark, sf):
    return out(_ps(spark, sf).select("order_id", "line_number", "product_id", "category",
                                     "status", "total_amount"))


J6_SQL = oracle("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, product_id, category, status, CAST(total_amount AS DOUBLE) AS total_amount
FROM star_ps""", PS_SQL)


def _d1(spark, sf):
    owc = joins.orders_with_customers(td.orders(spark, sf), td.customers(spark, sf))
    return out(drilldown.geo_drilldown(owc))


D1_SQL = oracle("""
SELECT o.region, c.country, CAST(GROUPING(o.region, c.country) AS BIGINT) AS level,
       COUNT(DISTINCT o.order_id) AS orders, CAST(SUM(o.total_amount) AS DOUBLE) AS revenue
FROM star_orders o LEFT JOIN star_customers c ON o.customer_id = c.customer_id
WHERE o.status = 'completed'
GROUP BY ROLLUP (o.region, c.country)""")


def _d2(spark, sf):
    return out(drilldown.product_drilldown(_ps(spark, sf)))


D2_SQL = oracle("""
SELECT category, subcategory, product_name,
       CAST(GROUPING(category, subcategory, product_name) AS BIGINT) AS level,
       CAST(SUM(line_amount * (1 - discount)) AS DOUBLE) AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold
FROM star_ps WHERE status = 'completed'
GROUP BY ROLLUP (category, subcategory, product_name)""", PS_SQL)


def _d3(spark, sf):
    return out(drilldown.time_drilldown(td.orders_plain(spark, sf)))


D3_SQL = oracle("""
SELECT year, quarter, month, day, CAST(GROUPING(year, quarter, month, day) AS BIGINT) AS level,
       COUNT(DISTINCT order_id) AS orders, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM (SELECT CAST(year(order_date) AS BIGINT) AS year, CAST(quarter(order_date) AS BIGINT) AS quarter,
             CAST(month(order_date) AS BIGINT) AS month, CAST(order_date AS DATE) AS day,
             order_id, total_amount
      FROM star_orders_plain WHERE status = 'completed') s
GROUP BY ROLLUP (year, quarter, month, day)""")


def _k(spark, sf):
    """K1-K10 at row level on orders."""
    o = td.orders_plain(spark, sf)
    as_of = M.latest_order_day(o)
    d = K.as_date(F.col("order_date"))
    return out(o.select(
        "order_id",
        d.alias("order_day"),                                                   # K1
        K.days_since_order(F.col("order_date"), as_of).alias("days_since"),     # K2, K3
        F.year(d).cast("long").alias("yr"), F.quarter(d).cast("long").alias("qtr"),
        F.month(d).cast("long").alias("mon"),
        F.trunc(d, "quarter").alias("quarter_start"),                           # K4
        K.order_size_category(F.col("total_amount") / 1000).alias("size_band"),  # K5
        (F.col("total_amount") * 2 - F.lit(1)).alias("doubled_less_one"),       # K6
        K.ratio(F.col("total_amount"), F.lit(1000)).alias("thousands"),         # K7
        ((F.col("status") == "completed") | F.col("status").isNull()).alias("completed_or_null"),  # K8
        F.col("status").like("c%").alias("status_like_c"),                      # K9
        (F.col("total_amount") < 150000).alias("under_150k"),                   # K10
    ))


K_SQL = oracle(f"""
SELECT order_id, CAST(order_date AS DATE) AS order_day,
       CAST(date_diff('day', CAST(order_date AS DATE), {AS_OF_SQL}) AS BIGINT) AS days_since,
       CAST(year(order_date) AS BIGINT) AS yr, CAST(quarter(order_date) AS BIGINT) AS qtr,
       CAST(month(order_date) AS BIGINT) AS mon,
       CAST(date_trunc('quarter', CAST(order_date AS DATE)) AS DATE) AS quarter_start,
       CASE WHEN total_amount / 1000 < 500 THEN 'Small' WHEN total_amount / 1000 < 1500 THEN 'Medium'
            ELSE 'Large' END AS size_band,
       CAST(total_amount * 2 - 1 AS DOUBLE) AS doubled_less_one,
       CAST(total_amount AS DOUBLE) / NULLIF(CAST(1000 AS DOUBLE), 0) AS thousands,
       (status = 'completed' OR status IS NULL) AS completed_or_null,
       status LIKE 'c%' AS status_like_c,
       total_amount < 150000 AS under_150k
FROM star_orders_plain""")

ENTRIES = {
    "c1_profit_margin_literal": (_c1, C1_SQL),
    "c2_profit_margin_pct": (_c2, C2_SQL),
    "c3_order_size_category": (_c3, C3_SQL),
    "c4_days_since_order": (_c4, C4_SQL),
    "c5_revenue_per_customer": (_c5, C5_SQL),
    "c6_order_conversion_rate": (_c6, C6_SQL),
    "c7_yoy_growth": (_c7, C7_SQL),
    "c8_mom_comparison": (_c8, C8_SQL),
    "c9_segment_share": (_c9_segment, C9S_SQL),
    "c9_category_share": (_c9_category, C9C_SQL),
    "c10_status_distribution": (_c10, C10_SQL),
    "c11_kpi_total_revenue": (_c11, C11_SQL),
    "c12_executive_kpis": (_c12, C12_SQL),
    "c13_product_kpis": (_c13, C13_SQL),
    "c14_customer_kpis": (_c14, C14_SQL),
    "c15_region_total_sales": (_c15, C15_SQL),
    "c16_revenue_trend": (_c16, C16_SQL),
    "c17_top10_products_by_header_total": (_c17, C17_SQL),
    "c18_product_details": (_c18, C18_SQL),
    "c19_category_trend": (_c19_category, C19C_SQL),
    "c19_product_trend": (_c19_product, C19P_SQL),
    "c20_periodic_sales": (_c20, C20_SQL),
    "c21_cross_sell": (_c21, C21_SQL),
    "c22_customer_lifetime_value": (_c22, C22_SQL),
    "c23_order_frequency_distribution": (_c23, C23_SQL),
    "c24_customer_acquisition": (_c24, C24_SQL),
    "c25_churn": (_c25, C25_SQL),
    "c26_rfm_segmentation": (_c26, C26_SQL),
    "c27_geo_distribution": (_c27, C27_SQL),
    "c28_conversion_funnel": (_c28, C28_SQL),
    "c29_target_status": (_c29, C29_SQL),
    "c30_color_scale": (_c30, C30_SQL),
    "c31_metric_alerts": (_c31, C31_SQL),
    "c32_pivot_sales": (_c32, C32_SQL),
    "c33_heatmap_feed": (_c33, C33_SQL),
    "j5_orders_with_customers": (_j5, J5_SQL),
    "j6_product_sales": (_j6, J6_SQL),
    "j7_co_occurrence": (_j7, J7_SQL),
    "d1_geo_drilldown": (_d1, D1_SQL),
    "d2_product_drilldown": (_d2, D2_SQL),
    "d3_time_drilldown": (_d3, D3_SQL),
    "k_scalar_functions": (_k, K_SQL),
}
