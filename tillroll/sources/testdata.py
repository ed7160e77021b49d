"""The star schema over the driver's TPC-H-like tables.

Mapping (a decision, the reference has no such data):

* orders      <- orders: o_orderkey, o_custkey, o_orderdate, o_totalprice as
                 DECIMAL(12,2); status F/O/P -> completed/pending/cancelled;
                 region from customer -> nation -> region.
* order_items <- lineitem: l_extendedprice already is quantity * unit_price,
                 so it is kept whole as ``line_amount``; the unit price is
                 never recovered by division.
* customers   <- customer: c_mktsegment -> customer_segment, nation -> country.
* products    <- part: p_type -> category, p_brand -> subcategory,
                 p_retailprice -> unit_cost.

An order without its customer, or a customer without a nation, stays, with a
NULL region and country.

Everything is lazy: Catalyst prunes the columns a query does not use and
pushes filters into the Parquet scans. nation (25 rows) and region (5 rows)
are fixed-size by definition and fall under the broadcast threshold; the
customer and part dimensions grow with the data and are joined however
Catalyst and AQE decide from measured sizes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import STATUS_CODES

MONEY = "decimal(12,2)"
RATE = "decimal(4,2)"

STATUS_NAMES = {code: name for name, code in STATUS_CODES.items()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def status_name(code: Column) -> Column:
    expr = F.when(code == "F", "completed")
    for k, v in STATUS_NAMES.items():
        if k != "F":
            expr = expr.when(code == k, v)
    return expr


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_key -> (country, region)."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(n.n_nationkey.alias("nation_key"), n.n_name.alias("country"),
                    r.r_name.alias("region")))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    g = geography(spark, sf_dir)
    return (c.join(g, c.c_nationkey == g.nation_key, "left")
            .select(c.c_custkey.alias("customer_id"), c.c_name.alias("name"),
                    c.c_mktsegment.alias("customer_segment"), g.country, g.region))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = customers(spark, sf_dir).select("customer_id", "region")
    return (o.join(c, o.o_custkey == c.customer_id, "left")
            .select(o.o_orderkey.alias("order_id"), o.o_custkey.alias("customer_id"),
                    o.o_orderdate.alias("order_date"),
                    o.o_totalprice.cast(MONEY).alias("total_amount"),
                    status_name(o.o_orderstatus).alias("status"), c.region,
                    o.o_orderstatus.alias("status_code")))


def orders_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders without the region lookup, for queries that do not need it."""
    o = table(spark, sf_dir, "orders")
    return o.select(o.o_orderkey.alias("order_id"), o.o_custkey.alias("customer_id"),
                    o.o_orderdate.alias("order_date"),
                    o.o_totalprice.cast(MONEY).alias("total_amount"),
                    status_name(o.o_orderstatus).alias("status"),
                    o.o_orderstatus.alias("status_code"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(li.l_orderkey.alias("order_id"), li.l_partkey.alias("product_id"),
                     li.l_linenumber.alias("line_number"),
                     li.l_quantity.cast("int").alias("quantity"),
                     li.l_extendedprice.cast(MONEY).alias("line_amount"),
                     li.l_discount.cast(RATE).alias("discount"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(p.p_partkey.alias("product_id"), p.p_name.alias("product_name"),
                    p.p_type.alias("category"), p.p_brand.alias("subcategory"),
                    p.p_retailprice.cast(MONEY).alias("unit_cost"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@dataclass
class Star:
    orders: DataFrame
    order_items: DataFrame
    customers: DataFrame
    products: DataFrame


def load_star(spark: SparkSession, sf_dir: str, with_region: bool = True) -> Star:
    return Star(
        orders=orders(spark, sf_dir) if with_region else orders_plain(spark, sf_dir),
        order_items=order_items(spark, sf_dir),
        customers=customers(spark, sf_dir),
        products=products(spark, sf_dir),
    )


# The same mapping as DuckDB/ANSI SQL common table expressions, used by the
# oracle queries: star_orders, star_items, star_customers, star_products.
ORACLE_STAR_SQL = """
star_geo AS (
  SELECT n.n_nationkey AS nation_key, n.n_name AS country, r.r_name AS region
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
star_customers AS (
  SELECT c.c_custkey AS customer_id, c.c_name AS name, c.c_mktsegment AS customer_segment,
         g.country, g.region
  FROM customer c LEFT JOIN star_geo g ON c.c_nationkey = g.nation_key),
star_orders AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderdate AS order_date,
         CAST(o.o_totalprice AS DECIMAL(12,2)) AS total_amount,
         CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
              WHEN 'P' THEN 'cancelled' END AS status,
         c.region
  FROM orders o LEFT JOIN star_customers c ON o.o_custkey = c.customer_id),
star_orders_plain AS (
  SELECT o.o_orderkey AS order_id, o.o_custkey AS customer_id, o.o_orderdate AS order_date,
         CAST(o.o_totalprice AS DECIMAL(12,2)) AS total_amount,
         CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending'
              WHEN 'P' THEN 'cancelled' END AS status
  FROM orders o),
star_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number,
         CAST(l_quantity AS INTEGER) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS line_amount,
         CAST(l_discount AS DECIMAL(4,2)) AS discount
  FROM lineitem),
star_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_brand AS subcategory, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_cost
  FROM part)
"""


def oracle(sql_body: str, ctes: str = "") -> str:
    """Prefix an oracle query with the star-schema CTEs (and any extra CTEs)."""
    extra = f",\n{ctes}" if ctes else ""
    return f"WITH {ORACLE_STAR_SQL}{extra}\n{sql_body}"
