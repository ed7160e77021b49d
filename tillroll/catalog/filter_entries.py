"""Catalog: filters and parameters F1-F11 (top / bottom / top-percent included)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.catalog.common import oracle, out
from tillroll.functions.columns import completed, line_revenue
from tillroll.operators import filters as FL, ranking
from tillroll.plans import metrics as M
from tillroll.plans.sales import completed_lines
from tillroll.session import shared_dir
from tillroll.sources import testdata as td

AS_OF_SQL = "(SELECT MAX(CAST(order_date AS DATE)) FROM star_orders_plain)"


def _rows(df):
    return out(df.select("order_id", F.to_date("order_date").alias("order_day"), "total_amount"))


ROWS_SQL = "SELECT order_id, CAST(order_date AS DATE) AS order_day, CAST(total_amount AS DOUBLE) AS total_amount FROM star_orders_plain"


def _f1(n):
    def run(spark, sf):
        o = td.orders_plain(spark, sf)
        return _rows(FL.last_days(o, "order_date", M.latest_order_day(o), n))
    return run


def _f1_sql(n):
    return oracle(f"""{ROWS_SQL}
WHERE CAST(order_date AS DATE) > {AS_OF_SQL} - INTERVAL {n} DAY AND CAST(order_date AS DATE) <= {AS_OF_SQL}""")


def _f2(unit, offset):
    def run(spark, sf):
        o = td.orders_plain(spark, sf)
        return _rows(FL.in_period(o, "order_date", M.latest_order_day(o), unit, offset))
    return run


def _f2_sql(unit, offset):
    months = {"month": 1, "quarter": 3}[unit]
    start = f"(CAST(date_trunc('{unit}', {AS_OF_SQL}) AS DATE) + INTERVAL ({offset * months}) MONTH)"
    return oracle(f"""{ROWS_SQL}
WHERE CAST(order_date AS DATE) >= {start} AND CAST(order_date AS DATE) < {start} + INTERVAL {months} MONTH""")


def _f3(spark, sf):
    return _rows(FL.between_dates(td.orders_plain(spark, sf), "order_date", "1998-01-01", "1998-04-01"))


F3_SQL = oracle(f"""{ROWS_SQL}
WHERE CAST(order_date AS DATE) >= DATE '1998-01-01' AND CAST(order_date AS DATE) < DATE '1998-04-01'""")


def _f4(spark, sf):
    o = FL.filter_in(FL.filter_in(td.orders(spark, sf), "region", ["EUROPE", "ASIA"]),
                     "status", ["completed", "pending"])
    return out(o.select("order_id", "region", "status", "total_amount"))


F4_SQL = oracle("""
SELECT order_id, region, status, CAST(total_amount AS DOUBLE) AS total_amount FROM star_orders
WHERE region IN ('EUROPE', 'ASIA') AND status IN ('completed', 'pending')""")


def _customer_revenue(spark, sf):
    return (completed(td.orders_plain(spark, sf)).groupBy("customer_id")
            .agg(F.sum("total_amount").alias("revenue")))


CUST_REV_SQL = """cr AS (SELECT customer_id, SUM(total_amount) AS revenue FROM star_orders_plain
  WHERE status = 'completed' GROUP BY 1)"""


def _f5(spark, sf):
    return out(ranking.top_n(_customer_revenue(spark, sf), "revenue", 10, ["customer_id"]))


F5_SQL = oracle("""SELECT customer_id, CAST(revenue AS DOUBLE) AS revenue FROM cr
ORDER BY revenue DESC, customer_id LIMIT 10""", CUST_REV_SQL)


def _f6_regions(spark, sf):
    rev = completed(td.orders(spark, sf)).groupBy("region").agg(F.sum("total_amount").alias("revenue"))
    return out(ranking.bottom_n(rev, "revenue", 5, ["region"]))


F6R_SQL = oracle("""SELECT region, CAST(SUM(total_amount) AS DOUBLE) AS revenue FROM star_orders
WHERE status = 'completed' GROUP BY 1 ORDER BY SUM(total_amount), region LIMIT 5""")


def _f6_countries(spark, sf):
    o = completed(td.orders_plain(spark, sf)).select("customer_id", "total_amount")
    rev = (o.join(td.customers(spark, sf).select("customer_id", "country"), "customer_id")
           .groupBy("country").agg(F.sum("total_amount").alias("revenue")))
    return out(ranking.bottom_n(rev, "revenue", 5, ["country"]))


F6C_SQL = oracle("""SELECT c.country, CAST(SUM(o.total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain o JOIN star_customers c ON o.customer_id = c.customer_id
WHERE o.status = 'completed' GROUP BY 1 ORDER BY SUM(o.total_amount), c.country LIMIT 5""")


def _f7(spark, sf):
    return out(ranking.top_percent(_customer_revenue(spark, sf), "revenue", 0.2, ["customer_id"]))


F7_SQL = oracle("""SELECT customer_id, revenue, rank FROM (
  SELECT customer_id, CAST(revenue AS DOUBLE) AS revenue,
         ROW_NUMBER() OVER (ORDER BY revenue DESC, customer_id) AS rank,
         COUNT(*) OVER () AS n
  FROM cr) s WHERE rank <= CEIL(n * 0.2)""", CUST_REV_SQL)

MIN_PRODUCT_REVENUE = 500000


def _f8(spark, sf):
    rev = (completed_lines(td.order_items(spark, sf), td.products(spark, sf), td.orders_plain(spark, sf))
           .groupBy("product_id", "product_name").agg(F.sum(line_revenue()).alias("revenue")))
    return out(FL.products_above(rev, MIN_PRODUCT_REVENUE))


F8_SQL = oracle(f"""
SELECT oi.product_id, p.product_name, CAST(SUM(oi.line_amount * (1 - oi.discount)) AS DOUBLE) AS revenue
FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
JOIN star_orders_plain o ON oi.order_id = o.order_id
WHERE o.status = 'completed' GROUP BY 1, 2
HAVING SUM(oi.line_amount * (1 - oi.discount)) >= {MIN_PRODUCT_REVENUE}""")

MIN_ORDER_AMOUNT = 300000


def _f9(spark, sf):
    return out(FL.orders_at_least(td.orders_plain(spark, sf), MIN_ORDER_AMOUNT)
               .select("order_id", "total_amount"))


F9_SQL = oracle(f"""SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount FROM star_orders_plain
WHERE total_amount >= {MIN_ORDER_AMOUNT}""")

# The example grants table of the row-level-security query.
GRANTS = [("analyst_emea", "EUROPE"), ("analyst_emea", "MIDDLE EAST"), ("analyst_emea", "AFRICA"),
          ("analyst_apac", "ASIA"), ("analyst_amer", "AMERICA")]


def _f10(spark, sf):
    path = shared_dir(spark, "grants")   # a stored table: its size is known, so the plan can broadcast it while it is small
    spark.createDataFrame(GRANTS, "user string, region string").coalesce(1).write.parquet(path)
    grants = spark.read.parquet(path)
    return out(FL.rows_for(td.orders(spark, sf), grants, "analyst_emea")
               .select("order_id", "region", "total_amount"))


F10_SQL = oracle("""SELECT order_id, region, CAST(total_amount AS DOUBLE) AS total_amount FROM star_orders
WHERE region IN (SELECT region FROM (VALUES ('analyst_emea', 'EUROPE'), ('analyst_emea', 'MIDDLE EAST'),
  ('analyst_emea', 'AFRICA'), ('analyst_apac', 'ASIA'), ('analyst_amer', 'AMERICA')) g(usr, region)
  WHERE usr = 'analyst_emea')""")


def _f11(spark, sf):
    return FL.hide_columns(td.customers(spark, sf), drop=["country", "region"], hash_cols=["name"])


F11_SQL = oracle("SELECT customer_id, sha256(name) AS name, customer_segment FROM star_customers")

ENTRIES = {
    "f1_last_7_days": (_f1(7), _f1_sql(7)),
    "f1_last_30_days": (_f1(30), _f1_sql(30)),
    "f2_last_quarter": (_f2("quarter", -1), _f2_sql("quarter", -1)),
    "f2_this_month": (_f2("month", 0), _f2_sql("month", 0)),
    "f3_custom_date_range": (_f3, F3_SQL),
    "f4_dimension_filter": (_f4, F4_SQL),
    "f5_top_customers": (_f5, F5_SQL),
    "f6_bottom_regions": (_f6_regions, F6R_SQL),
    "f6_bottom_countries": (_f6_countries, F6C_SQL),
    "f7_top_percent_customers": (_f7, F7_SQL),
    "f8_products_above_revenue": (_f8, F8_SQL),
    "f9_orders_at_least": (_f9, F9_SQL),
    "f10_row_level_security": (_f10, F10_SQL),
    "f11_column_level_security": (_f11, F11_SQL),
}
