"""Drill-down hierarchies (D1-D3): every level of a hierarchy in one frame.

``level`` is grouping_id() (0 = the finest level, all bits set = the grand
total). Sums roll up from the finest level by ROLLUP. Distinct orders do not
add up, so ``distinct_per_level`` finds, order by order, at which places of the
hierarchy an order is met for the first time: the orders are shuffled once, not
once per level, and the ROLLUP runs over one row per finest cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.columns import completed, line_revenue


def distinct_per_level(df: DataFrame, key: str, cell: list[str], levels: dict[str, Callable[[Column], Column]],
                       sums: list[str]) -> DataFrame:
    """One row per ``cell``: ``sums`` of its rows and, for each level, how many
    keys are counted there at that level.

    ``levels`` maps a column name to the group a cell (a struct) belongs to;
    in the cells' order a group's cells are neighbours. A key is counted at the
    first of its cells in each group, so adding a level's column over the cells
    of a group gives the group's distinct keys. A key's cells are a set: copies
    of a row are combined before the shuffle, and the set is at most as large
    as the hierarchy.
    """
    met = (df.where(F.col(key).isNotNull()).groupBy(key)
           .agg(F.array_sort(F.collect_set(F.struct(*cell))).alias("cells")))

    def first(x: Column, i: Column) -> Column:
        before = F.get("cells", i - 1)
        new = [((i == 0) | ~of(x).eqNullSafe(of(before))).cast("long").alias(name) for name, of in levels.items()]
        return F.struct(*[x[c].alias(c) for c in cell], *new)

    blank = [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in sums]
    counted = met.select(F.inline(F.transform("cells", first))).select(*cell, *levels, *blank)
    summed = df.select(*cell, *[F.lit(0).cast("long").alias(n) for n in levels], *sums)
    return counted.unionByName(summed).groupBy(*cell).agg(*[F.sum(c).alias(c) for c in [*levels, *sums]])


def geo_drilldown(orders_with_customers: DataFrame) -> DataFrame:
    """Region -> country over completed orders."""
    cells = distinct_per_level(
        completed(orders_with_customers).select("order_id", "region", "country", "total_amount"), "order_id", ["region", "country"],
        {"_all": lambda c: F.lit(1), "_region": lambda c: c["region"], "_country": lambda c: c}, ["total_amount"])
    return (cells.rollup("region", "country")
            .agg(F.grouping_id().cast("long").alias("level"),
                 F.when(F.grouping_id() == 0, F.sum("_country")).when(F.grouping_id() == 1, F.sum("_region"))
                 .otherwise(F.sum("_all")).alias("orders"),
                 F.sum("total_amount").alias("revenue")))


def product_drilldown(product_sales: DataFrame) -> DataFrame:
    """Category -> subcategory -> product over completed lines."""
    return (completed(product_sales)
            .rollup("category", "subcategory", "product_name")
            .agg(F.grouping_id().cast("long").alias("level"),
                 F.sum(line_revenue()).alias("revenue"),
                 F.sum("quantity").alias("units_sold")))


def time_drilldown(orders: DataFrame) -> DataFrame:
    """D3: year -> quarter -> month -> day over completed orders."""
    level = lambda unit: lambda c: F.trunc(c["day"], unit)
    days = distinct_per_level(
        completed(orders).select("order_id", F.to_date("order_date").alias("day"), "total_amount"), "order_id", ["day"],
        {"_all": lambda c: F.lit(1), "_year": level("year"), "_quarter": level("quarter"), "_month": level("month"),
         "_day": lambda c: c["day"]}, ["total_amount"])
    by_level = {0: "_day", 1: "_month", 3: "_quarter", 7: "_year"}
    n = F.sum("_all")
    for g, c in by_level.items():
        n = F.when(F.grouping_id() == g, F.sum(c)).otherwise(n)
    return (days.select(F.year("day").cast("long").alias("year"), F.quarter("day").cast("long").alias("quarter"),
                        F.month("day").cast("long").alias("month"), "day", "_all", *by_level.values(), "total_amount")
            .rollup("year", "quarter", "month", "day")
            .agg(F.grouping_id().cast("long").alias("level"), n.alias("orders"), F.sum("total_amount").alias("revenue")))
