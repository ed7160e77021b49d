"""Declared schemas: the landing-file tables and the dataset outputs.

Landing files are positional CSV with one header line; the schema is
declared up front and never inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

D = T.DecimalType

# Column lists and types of the four landing tables and the
# catch-all import table, in table order.
ORDERS = T.StructType([
    T.StructField("order_id", T.IntegerType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("order_date", T.TimestampNTZType()),
    T.StructField("total_amount", D(10, 2)),
    T.StructField("status", T.StringType()),
    T.StructField("region", T.StringType()),
])
ORDER_ITEMS = T.StructType([
    T.StructField("order_id", T.IntegerType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", D(10, 2)),
    T.StructField("discount", D(3, 2)),
])
CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("signup_date", T.DateType()),
    T.StructField("customer_segment", T.StringType()),
    T.StructField("country", T.StringType()),
])
PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("unit_cost", D(10, 2)),
    T.StructField("supplier_id", T.StringType()),
])
DATA_IMPORT = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("value", D(10, 2)),
    T.StructField("timestamp", T.TimestampNTZType()),
])

TABLES: dict[str, T.StructType] = {
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "data_import": DATA_IMPORT,
}

# Primary keys, NOT NULL columns and VARCHAR lengths of the
# landing tables.
PRIMARY_KEYS = {
    "orders": ["order_id"],
    "order_items": ["order_id", "product_id"],
    "customers": ["customer_id"],
    "products": ["product_id"],
    "data_import": [],
}
NOT_NULL = {
    "orders": ["order_id", "customer_id", "order_date", "total_amount", "status", "region"],
    "order_items": ["order_id", "product_id", "quantity", "unit_price"],
    "customers": ["customer_id", "name", "email", "signup_date", "customer_segment", "country"],
    "products": ["product_id", "product_name", "category", "subcategory", "unit_cost", "supplier_id"],
    "data_import": [],
}
MAX_LENGTH = {
    "orders": {"customer_id": 10, "status": 20, "region": 50},
    "order_items": {"product_id": 10},
    "customers": {"customer_id": 10, "name": 100, "email": 100, "customer_segment": 20, "country": 50},
    "products": {"product_id": 10, "product_name": 100, "category": 50, "subcategory": 50, "supplier_id": 10},
    "data_import": {"name": 255},
}
# Column defaults applied when a field arrives blank.
DEFAULTS = {"order_items": {"discount": "0.00"}}


def ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


# Declared output columns of the published datasets (name -> [(column, type)]).
DATASET_SCHEMAS: dict[str, list[tuple[str, T.DataType]]] = {
    "sales_by_region": [("region", T.StringType()), ("total_orders", T.LongType()),
                        ("total_revenue", D(38, 2)), ("avg_order_value", T.DoubleType())],
    "top_products": [("product_name", T.StringType()), ("category", T.StringType()),
                     ("revenue", D(38, 4)), ("units_sold", T.LongType())],
    "customer_segments": [("customer_segment", T.StringType()), ("customer_count", T.LongType()),
                          ("total_orders", T.LongType()), ("total_revenue", D(38, 2)),
                          ("avg_order_value", T.DoubleType())],
    "daily_sales": [("order_date", T.DateType()), ("orders", T.LongType()), ("revenue", D(38, 2))],
    "category_performance": [("category", T.StringType()), ("orders", T.LongType()),
                             ("units_sold", T.LongType()), ("revenue", D(38, 4)),
                             ("cost", D(38, 2)), ("profit", D(38, 4))],
    "daily_rollup": [("order_date", T.DateType()), ("region", T.StringType()), ("category", T.StringType()),
                     ("revenue", D(38, 4)), ("cost", D(38, 2)), ("units_sold", T.LongType()),
                     ("lines", T.LongType()), ("orders", T.LongType())],
    "order_sets": [("order_date", T.DateType()), ("region", T.StringType()),
                   ("categories", T.ArrayType(T.StringType())), ("orders", T.LongType())],
    "orders_with_customers": [("order_id", T.LongType()), ("customer_id", T.StringType()), ("order_date", T.TimestampNTZType()),
                              ("total_amount", D(12, 2)), ("status", T.StringType()), ("region", T.StringType()),
                              ("name", T.StringType()), ("customer_segment", T.StringType()), ("country", T.StringType())],
    "product_sales": [("order_id", T.LongType()), ("product_id", T.StringType()), ("quantity", T.IntegerType()),
                      ("line_amount", D(22, 2)), ("discount", D(4, 2)), ("product_name", T.StringType()),
                      ("category", T.StringType()), ("subcategory", T.StringType()), ("unit_cost", D(12, 2)),
                      ("customer_id", T.StringType()), ("order_date", T.TimestampNTZType()),
                      ("total_amount", D(12, 2)), ("status", T.StringType()), ("region", T.StringType())],
}
