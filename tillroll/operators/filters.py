"""Dashboard filters and parameters (F1-F11) as predicates and joins.

Date predicates compare the stored column, uncast, against bounds of its own
type, so they reach the Parquet scan (row groups are skipped by their min/max
statistics where the file is clustered by date), and a date-partitioned table
gets partition pruning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import lit_date


PART_MONTH = "order_month"


def _date_range(df: DataFrame, col: str, lo: Column, hi: Column, hi_inclusive: bool) -> DataFrame:
    """lo <= day(col) < hi (or <= hi), stated on the stored column. On a star
    partitioned by ``order_month`` the same range is also stated on the
    partition column, which Catalyst cannot derive from the date predicate
    itself, so only the months in range are listed and read."""
    kind = df.schema[col].dataType
    end = F.date_add(hi, 1) if hi_inclusive else hi
    cond = (F.col(col) >= lo.cast(kind)) & (F.col(col) < end.cast(kind))
    if col == "order_date" and PART_MONTH in df.columns:
        cond = cond & (F.col(PART_MONTH) >= F.trunc(lo, "month")) & (F.col(PART_MONTH) <= F.trunc(hi, "month"))
    return df.where(cond)


def last_days(df: DataFrame, col: str, as_of, n: int) -> DataFrame:
    """the last n days up to and including ``as_of``."""
    day = lit_date(as_of)
    return _date_range(df, col, F.date_sub(day, n - 1), day, True)


def in_period(df: DataFrame, col: str, as_of, unit: str = "month", offset: int = 0) -> DataFrame:
    """the calendar month / quarter / year containing ``as_of`` shifted by
    ``offset`` periods (offset -1 = last quarter), half-open."""
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    start = F.add_months(F.trunc(lit_date(as_of), unit), offset * months)
    end = F.add_months(start, months)
    return _date_range(df, col, start, end, False)


def between_dates(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """lo <= day < hi."""
    return _date_range(df, col, lit_date(lo), lit_date(hi), False)


def between_days(df: DataFrame, col: str, lo: Column, hi: Column) -> DataFrame:
    """lo <= day <= hi for DATE expressions."""
    return _date_range(df, col, lo, hi, True)


def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """multi-select dimension filter."""
    return df.where(F.col(col).isin(list(values)))


def products_above(product_revenue: DataFrame, min_revenue, measure: str = "revenue") -> DataFrame:
    """F8: HAVING revenue >= parameter."""
    return product_revenue.where(F.col(measure) >= F.lit(min_revenue))


def orders_at_least(orders: DataFrame, min_order_amount=100) -> DataFrame:
    """orders whose total reaches the parameter (default 100, inclusive)."""
    return orders.where(F.col("total_amount") >= F.lit(min_order_amount))


def rows_for(df: DataFrame, grants: DataFrame, user: str, key: str = "region") -> DataFrame:
    """row-level security, rows whose ``key`` the user is granted.

    A LEFT SEMI join against the grants table (user, key). Keep grants as a
    stored table: its size is then known, and while it is under the broadcast
    threshold the facts are not shuffled on the key's few values.
    """
    g = grants.where(F.col("user") == user).select(key)
    return df.join(g, key, "left_semi")


def hide_columns(df: DataFrame, drop=(), hash_cols=()) -> DataFrame:
    """column-level security: drop columns, replace others by SHA-256."""
    out = df.drop(*drop)
    for c in hash_cols:
        out = out.withColumn(c, F.sha2(F.col(c).cast("string"), 256))
    return out
