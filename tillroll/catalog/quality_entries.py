"""Catalog: data-quality operators V1-V8."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.catalog.common import oracle, out
from tillroll.operators import quality as Q
from tillroll.sources import testdata as td

# The star tables with the NOT NULL columns the reference declares.
NN = {
    "orders": ["order_id", "customer_id", "order_date", "total_amount", "status", "region"],
    "order_items": ["order_id", "product_id", "quantity", "line_amount"],
    "customers": ["customer_id", "name", "customer_segment", "country"],
    "products": ["product_id", "product_name", "category", "subcategory", "unit_cost"],
}
SQL_TABLE = {"orders": "star_orders", "order_items": "star_items", "customers": "star_customers",
             "products": "star_products"}


def _tables(spark, sf):
    return {"orders": td.orders(spark, sf), "order_items": td.order_items(spark, sf),
            "customers": td.customers(spark, sf), "products": td.products(spark, sf)}


# Faults put into the tables, derived from their keys: column -> (key, every
# n-th key). V1 sees NULLs, V6 values that break a rule.
NULLED = {"orders": {"status": ("order_id", 97), "region": ("order_id", 89)}, "order_items": {"quantity": ("order_id", 83)},
          "customers": {"name": ("customer_id", 11)}, "products": {"subcategory": ("product_id", 13)}}
BROKEN = {"orders": {"status": ("order_id", 97, "'lost'"), "total_amount": ("order_id", 89, "-total_amount")},
          "order_items": {"quantity": ("order_id", 83, "-quantity"), "discount": ("product_id", 79, "1.5")}}


def _fault_columns(cols, faults):
    """SELECT list in which every n-th key's column has the fault (NULL where none is given)."""
    def one(c):
        if c not in faults:
            return c
        key, n, *value = faults[c]
        return f"CASE WHEN {key} % {n} = 0 THEN {value[0] if value else 'NULL'} ELSE {c} END AS {c}"
    return [one(c) for c in cols]


def _v1(spark, sf):
    t = _tables(spark, sf)
    t = {n: df.selectExpr(*_fault_columns(NN[n], NULLED[n])) for n, df in t.items()}
    return reduce(DataFrame.unionByName, [Q.check_not_null(t[n], cols, n) for n, cols in NN.items()])


V1_SQL = oracle("\nUNION ALL\n".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count "
    f"FROM (SELECT {', '.join(_fault_columns(cols, NULLED[n]))} FROM {SQL_TABLE[n]}) t" for n, cols in NN.items() for c in cols))


def _v2_items_product(spark, sf):
    return Q.check_unique(td.order_items(spark, sf), ["order_id", "product_id"])


V2P_SQL = oracle("""SELECT order_id, product_id, COUNT(*) AS copies FROM star_items
GROUP BY 1, 2 HAVING COUNT(*) > 1""")


def _v2_items_line(spark, sf):
    return Q.check_unique(td.order_items(spark, sf), ["order_id", "line_number"])


V2L_SQL = oracle("""SELECT order_id, line_number, COUNT(*) AS copies FROM star_items
GROUP BY 1, 2 HAVING COUNT(*) > 1""")


def _v2_orders(spark, sf):
    return Q.check_unique(td.orders_plain(spark, sf), ["order_id"])


V2O_SQL = oracle("SELECT order_id, COUNT(*) AS copies FROM star_orders_plain GROUP BY 1 HAVING COUNT(*) > 1")

# The reference declaration of orders, applied to the star orders.
ORDERS_DECLARED = T.StructType([
    T.StructField("order_id", T.IntegerType()), T.StructField("customer_id", T.StringType()),
    T.StructField("order_date", T.TimestampNTZType()), T.StructField("total_amount", T.DecimalType(10, 2)),
    T.StructField("status", T.StringType()), T.StructField("region", T.StringType())])
ORDERS_LENGTHS = {"customer_id": 10, "status": 20, "region": 50}


# Orders as text, with a bad value at every n-th order.
AS_TEXT = ["CASE WHEN order_id % 97 = 0 THEN 'no' || CAST(order_id AS {t}) ELSE CAST(order_id AS {t}) END AS order_id",
           "CAST(customer_id AS {t}) AS customer_id",
           "CASE WHEN order_id % 89 = 0 THEN 'yesterday' ELSE CAST(order_date AS {t}) END AS order_date",
           "CASE WHEN order_id % 83 = 0 THEN 'free' ELSE CAST(total_amount AS {t}) END AS total_amount",
           "CASE WHEN order_id % 79 = 0 THEN status || ' but not delivered' ELSE status END AS status",
           "CASE WHEN order_id % 73 = 0 THEN NULL ELSE region END AS region"]


def _v3(spark, sf):
    text = td.orders(spark, sf).selectExpr(*[c.format(t="STRING") for c in AS_TEXT])
    return Q.check_types(text, ORDERS_DECLARED, ORDERS_LENGTHS, "orders")


V3_SQL = oracle("""
SELECT 'orders' AS table_name, 'order_id' AS column_name,
       COUNT(*) FILTER (WHERE order_id IS NOT NULL AND TRY_CAST(order_id AS INTEGER) IS NULL) AS violations FROM texts
UNION ALL SELECT 'orders', 'customer_id', COUNT(*) FILTER (WHERE length(customer_id) > 10) FROM texts
UNION ALL SELECT 'orders', 'order_date', COUNT(*) FILTER (WHERE order_date IS NOT NULL AND TRY_CAST(order_date AS TIMESTAMP) IS NULL) FROM texts
UNION ALL SELECT 'orders', 'total_amount', COUNT(*) FILTER (WHERE total_amount IS NOT NULL AND TRY_CAST(total_amount AS DECIMAL(10,2)) IS NULL) FROM texts
UNION ALL SELECT 'orders', 'status', COUNT(*) FILTER (WHERE length(status) > 20) FROM texts
UNION ALL SELECT 'orders', 'region', COUNT(*) FILTER (WHERE length(region) > 50) FROM texts""",
                f"texts AS (SELECT {', '.join(c.format(t='VARCHAR') for c in AS_TEXT)} FROM star_orders)")


def _v4(spark, sf):
    items, o = td.order_items(spark, sf), td.orders_plain(spark, sf)
    return Q.check_refs({
        "order_items.order_id -> orders": (items, o, "order_id"),
        "order_items.product_id -> products": (items, td.products(spark, sf), "product_id"),
        "orders.customer_id -> customers": (o, td.customers(spark, sf), "customer_id"),
    })


V4_SQL = oracle("""
SELECT 'order_items.order_id -> orders' AS check_name, COUNT(*) AS orphans FROM star_items i
WHERE NOT EXISTS (SELECT 1 FROM star_orders_plain o WHERE o.order_id = i.order_id)
UNION ALL SELECT 'order_items.product_id -> products', COUNT(*) FROM star_items i
WHERE NOT EXISTS (SELECT 1 FROM star_products p WHERE p.product_id = i.product_id)
UNION ALL SELECT 'orders.customer_id -> customers', COUNT(*) FROM star_orders_plain o
WHERE NOT EXISTS (SELECT 1 FROM star_customers c WHERE c.customer_id = o.customer_id)""")


def _v5(spark, sf):
    return out(Q.reconcile_orders(td.orders_plain(spark, sf), td.order_items(spark, sf)))


V5_SQL = oracle("""
SELECT o.order_id, CAST(o.total_amount AS DOUBLE) AS header_total,
       CAST(COALESCE(l.line_total, 0) AS DOUBLE) AS line_total,
       CAST(o.total_amount - COALESCE(l.line_total, 0) AS DOUBLE) AS difference
FROM star_orders_plain o LEFT JOIN (
  SELECT order_id, SUM(line_amount * (1 - discount)) AS line_total FROM star_items GROUP BY 1) l
ON o.order_id = l.order_id""")


def item_rules():
    return {
        "order_id_not_null": F.col("order_id").isNotNull(),
        "product_id_not_null": F.col("product_id").isNotNull(),
        "quantity_positive": F.col("quantity") > 0,
        "line_amount_not_negative": F.col("line_amount") >= 0,
        "discount_fraction": F.col("discount").isNull() | F.col("discount").between(0, 1),
    }


def order_rules():
    from tillroll.plans.metrics import STATUSES
    r = Q.schema_rules(ORDERS_DECLARED, NN["orders"], ORDERS_LENGTHS)
    r["status_known"] = F.col("status").isin(list(STATUSES))
    r["total_not_negative"] = F.col("total_amount") >= 0
    return r


def _v6(spark, sf):
    items, orders = td.order_items(spark, sf), td.orders(spark, sf)
    items = items.selectExpr(*_fault_columns(items.columns, BROKEN["order_items"]))
    orders = orders.selectExpr(*_fault_columns(orders.columns, BROKEN["orders"]))
    return Q.validation_summary(items, item_rules(), "order_items").unionByName(
        Q.validation_summary(orders, order_rules(), "orders"))


V6_SQL = oracle("""
SELECT 'order_items' AS table_name,
       COUNT(*) FILTER (WHERE ok) AS good_rows, COUNT(*) FILTER (WHERE NOT ok) AS rejected_rows
FROM (SELECT COALESCE(order_id IS NOT NULL, FALSE) AND COALESCE(product_id IS NOT NULL, FALSE)
             AND COALESCE(quantity > 0, FALSE) AND COALESCE(line_amount >= 0, FALSE)
             AND COALESCE(discount IS NULL OR discount BETWEEN 0 AND 1, FALSE) AS ok FROM bad_items) i
UNION ALL
SELECT 'orders', COUNT(*) FILTER (WHERE ok), COUNT(*) FILTER (WHERE NOT ok)
FROM (SELECT order_id IS NOT NULL AND customer_id IS NOT NULL AND order_date IS NOT NULL
             AND total_amount IS NOT NULL AND status IS NOT NULL AND region IS NOT NULL
             AND length(CAST(customer_id AS VARCHAR)) <= 10 AND length(status) <= 20 AND length(region) <= 50
             AND COALESCE(status IN ('completed', 'pending', 'cancelled'), FALSE)
             AND COALESCE(total_amount >= 0, FALSE) AS ok FROM bad_orders) o""",
                "bad_items AS (SELECT " + ", ".join(_fault_columns(
                    ["order_id", "product_id", "line_number", "quantity", "line_amount", "discount"], BROKEN["order_items"])) + """ FROM star_items),
bad_orders AS (SELECT """ + ", ".join(_fault_columns(
                    ["order_id", "customer_id", "order_date", "total_amount", "status", "region"], BROKEN["orders"])) + " FROM star_orders)")

def _v8(spark, sf):
    return out(Q.dedupe(td.order_items(spark, sf), ["order_id", "line_number"],
                        ["product_id", "quantity", "line_amount", "discount"]))


V8_SQL = oracle("""
SELECT order_id, CAST(line_number AS BIGINT) AS line_number, product_id, CAST(quantity AS BIGINT) AS quantity,
       CAST(line_amount AS DOUBLE) AS line_amount, CAST(discount AS DOUBLE) AS discount
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id, line_number
        ORDER BY product_id DESC, quantity DESC, line_amount DESC, discount DESC) AS rn
      FROM star_items) s WHERE rn = 1""")

ENTRIES = {
    "v1_not_null": (_v1, V1_SQL),
    "v2_unique_item_product": (_v2_items_product, V2P_SQL),
    "v2_unique_item_line": (_v2_items_line, V2L_SQL),
    "v2_unique_orders": (_v2_orders, V2O_SQL),
    "v3_type_conformity": (_v3, V3_SQL),
    "v4_referential": (_v4, V4_SQL),
    "v5_reconcile_orders": (_v5, V5_SQL),
    "v6_validate_summary": (_v6, V6_SQL),
    "v8_dedupe_items": (_v8, V8_SQL),
}
