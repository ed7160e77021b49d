"""The joined datasets of the BI layer (J5, J6) and basket co-occurrence.

No broadcast hints: the customer and product dimensions grow with the
data, so Catalyst's size estimate (autoBroadcastJoinThreshold) and AQE's
measured shuffle sizes decide between broadcast and sort-merge join, and
AQE splits a skewed join key (one customer or one order holding a large
share of the rows) into several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import with_line_amount


def orders_with_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders LEFT JOIN customers (every order kept)."""
    c = customers.drop("region") if "region" in orders.columns else customers
    return orders.join(c, "customer_id", "left")


def order_keys(items: DataFrame, orders: DataFrame) -> list[str]:
    """Join keys of items -> orders. A star partitioned by ``order_month``
    carries it on both tables; adding it to the key (it is a function of
    order_id, so the result is the same) lets Spark's dynamic partition
    pruning skip the item partitions of months the orders side filtered out."""
    if "order_month" in items.columns and "order_month" in orders.columns:
        return ["order_id", "order_month"]
    return ["order_id"]


def product_sales(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """order_items JOIN products JOIN orders (item grain)."""
    return with_line_amount(items).join(products, "product_id").join(orders, order_keys(items, orders))


def baskets(items: DataFrame) -> DataFrame:
    """Distinct (order_id, product_id) pairs: one row per product per order."""
    return items.select("order_id", "product_id").distinct()


def co_occurrence(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """For each anchor product, every product sharing an order with it.

    Only pairs that contain an anchor are produced, so the output grows
    linearly with the orders holding an anchor, never with the square of a
    basket. Output: anchor_id, product_id, pair_orders.
    """
    b = baskets(items)
    a = (b.join(anchors.select(F.col("product_id")).distinct(), "product_id", "left_semi")
         .select("order_id", F.col("product_id").alias("anchor_id")))
    return (a.join(b, "order_id")
            .where(F.col("product_id") != F.col("anchor_id"))
            .groupBy("anchor_id", "product_id")
            .agg(F.count(F.lit(1)).alias("pair_orders")))
