"""Calculated fields and scalar helpers, all built-in Column expressions.

Nothing here is a Python UDF: each function returns a Column that stays
inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = [
    "with_line_amount", "line_revenue", "line_cost", "ratio", "pct",
    "order_size_category", "days_since_order", "as_date", "lit_date",
    "completed", "STATUS_CODES",
]


def lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def with_line_amount(items: DataFrame) -> DataFrame:
    """Normalise an order-items frame to carry ``line_amount`` (= quantity *
    unit_price) and a non-null ``discount`` (the column default is 0.00)."""
    cols = items.columns
    out = items
    if "line_amount" not in cols:
        out = out.withColumn("line_amount", F.col("quantity") * F.col("unit_price"))
    return out.withColumn("discount", F.coalesce(F.col("discount"), F.lit(0).cast("decimal(3,2)")))


def line_revenue() -> Column:
    """quantity * unit_price * (1 - discount), exact decimal."""
    return F.col("line_amount") * (F.lit(1) - F.col("discount"))


def line_cost() -> Column:
    """quantity * unit_cost."""
    return F.col("quantity") * F.col("unit_cost")


def ratio(num: Column, den: Column) -> Column:
    """num / den as DOUBLE; NULL when den is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column) -> Column:
    return ratio(num, den) * F.lit(100.0)


def as_date(c: Column) -> Column:
    """DATE(ts)."""
    return F.to_date(c)


# The one-letter order status codes of a coded source and
# their status names.
STATUS_CODES = {"completed": "F", "pending": "O", "cancelled": "P"}


def completed(df: DataFrame) -> DataFrame:
    """status = 'completed'.

    A frame mapped from a coded source keeps the raw ``status_code``; the
    filter then compares the stored code, a plain equality that Parquet
    can push down (the name is a CASE over the code and cannot be pushed).
    """
    if "status_code" in df.columns:
        return df.where(F.col("status_code") == STATUS_CODES["completed"])
    return df.where(F.col("status") == "completed")


# Order size bands of the calculated field.
SIZE_SMALL_BELOW = 500
SIZE_MEDIUM_BELOW = 1500


def order_size_category(amount: Column) -> Column:
    return (F.when(amount < SIZE_SMALL_BELOW, "Small")
            .when(amount < SIZE_MEDIUM_BELOW, "Medium")
            .otherwise("Large"))


def days_since_order(order_date: Column, as_of) -> Column:
    """Whole days from the order date to ``as_of`` (positive for past orders)."""
    return F.datediff(lit_date(as_of), F.to_date(order_date)).cast("long")
