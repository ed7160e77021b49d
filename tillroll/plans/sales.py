"""The named sales queries.

Every builder is a pure DataFrame -> DataFrame function over the star
schema. Measures stay exact DECIMAL until the end; averages are
sum / count in DOUBLE so that every engine gives the same bits.
Sorts name the NULL order explicitly (Spark's DESC is NULLS LAST).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import completed, line_cost, line_revenue, ratio, with_line_amount
from tillroll.operators.joins import order_keys


def sales_by_region(orders: DataFrame) -> DataFrame:
    """A1: completed orders per region, revenue descending."""
    return (completed(orders)
            .groupBy("region")
            .agg(F.countDistinct("order_id").alias("total_orders"),
                 F.sum("total_amount").alias("total_revenue"),
                 ratio(F.sum("total_amount"), F.count("total_amount")).alias("avg_order_value"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), F.col("region")))


def completed_lines(items: DataFrame, products: DataFrame, orders: DataFrame,
                    keep: tuple[str, ...] = ()) -> DataFrame:
    """items JOIN products JOIN orders WHERE status = 'completed' (J1 + J2 + P3).

    Only the join key of orders (plus ``keep``) survives the projection, so
    the orders scan reads few columns and the status predicate is pushed
    into it.
    """
    keys = order_keys(items, orders)
    o = completed(orders).select(*keys, *[k for k in keep if k not in keys])
    return (with_line_amount(items)
            .join(products, "product_id")
            .join(o, keys))


def top_products(items: DataFrame, products: DataFrame, orders: DataFrame, n: int = 10) -> DataFrame:
    """A2: completed line revenue and units per (product_name, category), top n.

    Groups by name + category, not product id, so same-named products merge.
    ORDER BY ... LIMIT plans as TakeOrderedAndProject: each task keeps its
    own top n, no global sort.
    """
    return top_products_of(completed_lines(items, products, orders), n)


def top_products_of(lines: DataFrame, n: int = 10) -> DataFrame:
    """A2 over completed lines."""
    return (lines.groupBy("product_name", "category")
            .agg(F.sum(line_revenue()).alias("revenue"),
                 F.sum("quantity").alias("units_sold"))
            .orderBy(F.col("revenue").desc_nulls_last(), "product_name", "category")
            .limit(n))


def customers_left_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers LEFT JOIN orders, every column of both, built skew-safe.

    An outer join cannot split its right side, so all orders of one customer
    would meet in one task. Here the orders are the left side of an inner join,
    which AQE splits where one customer holds much of the table, and the
    customers without orders come from an anti join against the distinct
    customer ids (partial aggregation first).
    """
    rest = [c for c in orders.columns if c != "customer_id"]
    matched = orders.join(customers, "customer_id").select(*customers.columns, *rest)
    lonely = customers.join(orders.select("customer_id").distinct(), "customer_id", "left_anti")
    return matched.unionByName(lonely.select(*customers.columns, *[F.lit(None).cast(orders.schema[c].dataType).alias(c) for c in rest]))


def segment_rows(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """The rows of ``customers LEFT JOIN orders WHERE status = 'completed' OR
    status IS NULL``, built skew-safe.

    Those rows are (a) every order whose status is completed or NULL, joined
    to its customer, and (b) one NULL-order row per customer without any
    order. Written that way the big orders side is the *left* side of an
    inner join (AQE can split a customer holding a large share of the
    orders), and (b) anti-joins customers against the distinct customer ids
    of orders (partial aggregation first, one row per customer). The literal
    outer join would put all of a hot customer's orders into one task,
    because a left outer join cannot split its right side.
    """
    c = customers.select("customer_id", "customer_segment")
    o = orders.select("customer_id", "order_id", "total_amount", "status")
    kept = (o.where((F.col("status") == "completed") | F.col("status").isNull())
            .join(c, "customer_id"))
    buyers = orders.select("customer_id").distinct()
    lonely = (c.join(buyers, "customer_id", "left_anti")
              .select("customer_id", F.lit(None).cast(o.schema["order_id"].dataType).alias("order_id"),
                      F.lit(None).cast(o.schema["total_amount"].dataType).alias("total_amount"),
                      F.lit(None).cast("string").alias("status"), "customer_segment"))
    return kept.unionByName(lonely)


def customer_segments(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """A3: customers LEFT JOIN orders, then status = 'completed' OR status IS NULL.

    Semantics kept literally: a customer whose orders are all pending /
    cancelled drops out, a customer without any order stays (with NULL
    revenue). See ``segment_rows`` for the skew-safe form of the join.
    """
    return (segment_rows(customers, orders)
            .groupBy("customer_segment")
            .agg(F.countDistinct("customer_id").alias("customer_count"),
                 F.countDistinct("order_id").alias("total_orders"),
                 F.sum("total_amount").alias("total_revenue"),
                 ratio(F.sum("total_amount"), F.count("total_amount")).alias("avg_order_value"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), "customer_segment"))


def daily_sales(orders: DataFrame) -> DataFrame:
    """A4: completed orders and revenue per calendar day, by date."""
    return (completed(orders)
            .groupBy(F.to_date("order_date").alias("order_date"))
            .agg(F.countDistinct("order_id").alias("orders"),
                 F.sum("total_amount").alias("revenue"))
            .orderBy("order_date"))


def category_performance(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """A5: orders, units, revenue, cost and profit per category."""
    return category_performance_of(completed_lines(items, products, orders))


def category_performance_of(lines: DataFrame) -> DataFrame:
    """A5 over completed lines."""
    return (lines.groupBy("category")
            .agg(F.countDistinct("order_id").alias("orders"),
                 F.sum("quantity").alias("units_sold"),
                 F.sum(line_revenue()).alias("revenue"),
                 F.sum(line_cost()).alias("cost"))
            .withColumn("profit", F.col("revenue") - F.col("cost"))
            .orderBy(F.col("revenue").desc_nulls_last(), "category"))


def segment_sales_inner(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Completed orders INNER JOIN customers per segment."""
    o = completed(orders).select("customer_id", "order_id", "total_amount")
    return (o.join(customers.select("customer_id", "customer_segment"), "customer_id")
            .groupBy("customer_segment")
            .agg(F.countDistinct("order_id").alias("total_orders"),
                 F.sum("total_amount").alias("total_revenue"))
            .orderBy(F.col("total_revenue").desc_nulls_last(), "customer_segment"))


def count_rows(df: DataFrame, alias: str) -> DataFrame:
    """SELECT COUNT(*) AS alias."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One (table_name, row_count) row per table, UNION ALL.

    Each branch is a global count: partial counts per task, a single-row
    final aggregate; the scans read no columns.
    """
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
