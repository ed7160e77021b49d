"""The reference's four sample CSV files as inline rows (fixed values, in
file order), and a star built from them."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from tillroll import schemas as S
from tillroll.sources.testdata import Star

# The sample orders (10 rows, in file order).
ORDERS = [
    (1001, "C001", "2024-01-15 10:23:00", "1250.50", "completed", "us-east"),
    (1002, "C002", "2024-01-15 11:45:00", "890.25", "completed", "us-west"),
    (1003, "C003", "2024-01-15 14:30:00", "2340.00", "completed", "eu-west"),
    (1004, "C001", "2024-01-16 09:15:00", "567.80", "completed", "us-east"),
    (1005, "C004", "2024-01-16 13:20:00", "1890.00", "pending", "ap-southeast"),
    (1006, "C005", "2024-01-16 15:45:00", "3200.50", "completed", "us-east"),
    (1007, "C002", "2024-01-17 08:30:00", "445.75", "completed", "us-west"),
    (1008, "C006", "2024-01-17 10:00:00", "1567.90", "cancelled", "eu-west"),
    (1009, "C003", "2024-01-17 16:20:00", "890.00", "completed", "eu-west"),
    (1010, "C007", "2024-01-18 11:30:00", "2100.00", "completed", "ap-southeast"),
]
# The sample order items (16 rows, in file order).
ORDER_ITEMS = [
    (1001, "P101", 2, "250.00", "0.10"), (1001, "P102", 3, "300.00", "0.00"),
    (1002, "P103", 1, "890.25", "0.00"), (1003, "P101", 5, "250.00", "0.15"),
    (1003, "P104", 4, "275.00", "0.05"), (1004, "P102", 1, "300.00", "0.00"),
    (1004, "P105", 2, "150.00", "0.10"), (1005, "P106", 3, "630.00", "0.00"),
    (1006, "P101", 8, "250.00", "0.20"), (1006, "P107", 5, "400.00", "0.00"),
    (1007, "P103", 1, "890.25", "0.50"), (1008, "P104", 4, "275.00", "0.00"),
    (1008, "P108", 2, "350.00", "0.10"), (1009, "P105", 5, "150.00", "0.10"),
    (1009, "P106", 1, "630.00", "0.50"), (1010, "P107", 5, "400.00", "0.05"),
]
# The sample customers (7 rows, in file order).
CUSTOMERS = [
    ("C001", "John Smith", "john.smith@email.com", "2023-06-15", "premium", "USA"),
    ("C002", "Sarah Johnson", "sarah.j@email.com", "2023-08-22", "standard", "USA"),
    ("C003", "Michael Brown", "m.brown@email.com", "2023-05-10", "premium", "UK"),
    ("C004", "Emily Chen", "emily.chen@email.com", "2023-11-03", "standard", "Singapore"),
    ("C005", "David Wilson", "d.wilson@email.com", "2023-03-18", "enterprise", "USA"),
    ("C006", "Maria Garcia", "maria.g@email.com", "2023-09-25", "standard", "Spain"),
    ("C007", "James Lee", "james.lee@email.com", "2023-07-12", "premium", "Singapore"),
]
# The sample products (8 rows, in file order).
PRODUCTS = [
    ("P101", "Laptop Pro 15", "Electronics", "Computers", "180.00", "S001"),
    ("P102", "Wireless Mouse", "Electronics", "Accessories", "25.00", "S002"),
    ("P103", "Office Chair Deluxe", "Furniture", "Seating", "450.00", "S003"),
    ("P104", "Standing Desk", "Furniture", "Desks", "200.00", "S003"),
    ("P105", "USB-C Hub", "Electronics", "Accessories", "80.00", "S002"),
    ("P106", "Monitor 27inch", "Electronics", "Displays", "400.00", "S001"),
    ("P107", "Ergonomic Keyboard", "Electronics", "Accessories", "150.00", "S002"),
    ("P108", "Desk Lamp LED", "Furniture", "Lighting", "100.00", "S004"),
]


def _typed(row, schema):
    out = []
    for v, f in zip(row, schema.fields):
        t = f.dataType.simpleString()
        if v is None:
            out.append(None)
        elif t.startswith("decimal"):
            out.append(Dec(v))
        elif t == "timestamp_ntz":
            out.append(dt.datetime.fromisoformat(v))
        elif t == "date":
            out.append(dt.date.fromisoformat(v))
        else:
            out.append(v)
    return tuple(out)


def frame(spark, rows, schema):
    return spark.createDataFrame([_typed(r, schema) for r in rows], schema)


def csv_text(header: str, rows) -> str:
    return header + "\n" + "\n".join(",".join(str(v) for v in r) for r in rows) + "\n"


def sample_star(spark) -> Star:
    items = frame(spark, ORDER_ITEMS, S.ORDER_ITEMS)
    return Star(
        orders=frame(spark, ORDERS, S.ORDERS),
        order_items=items.withColumn("line_amount", F.col("quantity") * F.col("unit_price")),
        customers=frame(spark, CUSTOMERS, S.CUSTOMERS),
        products=frame(spark, PRODUCTS, S.PRODUCTS),
    )
