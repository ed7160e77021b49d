"""The BI metric layer (C1-C33): calculated fields, KPIs, chart feeds,
customer analytics, cross-sell, targets and pivots.

Conventions: measures are exact DECIMAL sums; ratios are DOUBLE with NULL
for a zero or missing denominator; ``as_of`` is a date or a Column (e.g. a
scalar subquery for "latest day in the data"), never the wall clock.
Windows only run over already-aggregated, bounded frames (segments,
categories, months, days per region); per-customer ranks use the
distributed ``global_rank``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators import filters
from tillroll.functions.columns import (
    completed, days_since_order, line_cost, line_revenue, lit_date, order_size_category,
    pct, ratio,
)
from tillroll.operators.joins import baskets, co_occurrence
from tillroll.operators.ranking import ntile_global
from tillroll.plans.drilldown import distinct_per_level


def latest_order_day(orders: DataFrame) -> Column:
    """Scalar subquery: the latest order date in the data (the reproducible 'now')."""
    return orders.select(F.max(F.to_date("order_date"))).scalar()


# --- calculated fields ------------------------------------------------------

def profit_margin_literal(product_sales: DataFrame) -> DataFrame:
    """(sum(total_amount) - sum(unit_cost * quantity)) / sum(total_amount)
    over item-grain rows: each order's header total counts once per line."""
    return product_sales.agg(
        F.sum("total_amount").alias("fanned_total_amount"),
        F.sum(line_cost()).alias("cost"),
    ).withColumn("profit_margin", ratio(F.col("fanned_total_amount") - F.col("cost"),
                                        F.col("fanned_total_amount")))


def profit_margin_pct(category_perf: DataFrame) -> DataFrame:
    """(revenue - cost) / revenue * 100 per category."""
    return category_perf.select(
        "category", "revenue", "cost",
        (ratio(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100.0).alias("profit_margin_pct"))


def order_size_distribution(orders: DataFrame) -> DataFrame:
    """C3 as a feed: orders and header revenue per size band."""
    return (orders.groupBy(order_size_category(F.col("total_amount")).alias("order_size_category"))
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("revenue")))


def with_days_since_order(orders: DataFrame, as_of) -> DataFrame:
    """C4: whole days from order_date to as_of."""
    return orders.withColumn("days_since_order", days_since_order(F.col("order_date"), as_of))


def revenue_per_customer(orders: DataFrame) -> DataFrame:
    """sum(total revenue) / distinctCount(customer_id), completed orders."""
    return (completed(orders)
            .agg(F.sum("total_amount").alias("total_revenue"),
                 F.countDistinct("customer_id").alias("customers"))
            .withColumn("revenue_per_customer", ratio(F.col("total_revenue"), F.col("customers"))))


def order_conversion_rate(orders: DataFrame) -> DataFrame:
    """count(completed) / count(all) * 100."""
    return (orders.agg(F.count_if(F.col("status") == "completed").alias("completed_orders"),
                       F.count(F.lit(1)).alias("total_orders"))
            .withColumn("conversion_rate_pct", pct(F.col("completed_orders"), F.col("total_orders"))))


def _period_growth(series: DataFrame, key: str, prev_key: Column, measure: str,
                   prefix: str) -> DataFrame:
    """Join each period to its immediate predecessor (a gap gives NULL)."""
    prev = series.select(F.col(key).alias("_pk"), F.col(measure).alias(f"prev_{measure}"))
    s = series.withColumn("_pk", prev_key)
    return (s.join(prev, "_pk", "left").drop("_pk")
            .withColumn(f"{prefix}_change", F.col(measure) - F.col(f"prev_{measure}"))
            .withColumn(f"{prefix}_growth_pct",
                        pct(F.col(measure) - F.col(f"prev_{measure}"), F.col(f"prev_{measure}"))))


def yoy_growth(orders: DataFrame) -> DataFrame:
    """Completed revenue per year vs the previous calendar year."""
    yearly = (completed(orders).groupBy(F.year("order_date").cast("long").alias("year"))
              .agg(F.sum("total_amount").alias("revenue")))
    return _period_growth(yearly, "year", F.col("year") - 1, "revenue", "yoy")


def mom_comparison(orders: DataFrame) -> DataFrame:
    """Completed revenue per month vs the previous calendar month."""
    monthly = (completed(orders)
               .groupBy(F.trunc(F.to_date("order_date"), "month").alias("month"))
               .agg(F.sum("total_amount").alias("revenue")))
    return _period_growth(monthly, "month", F.add_months("month", -1), "revenue", "mom")


def share_of_total(agg: DataFrame, measure: str, name: str = "share_pct") -> DataFrame:
    """Measure as a percentage of its column total.

    The total is a scalar subquery (a distributed global sum), not an
    unpartitioned window, so it stays correct and parallel however many
    groups the aggregate has.
    """
    total = agg.select(F.sum(measure)).scalar()
    return agg.withColumn(name, pct(F.col(measure), total))


def segment_share(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """C9 by customer segment: completed revenue share."""
    seg = (completed(orders).select("customer_id", "total_amount")
           .join(customers.select("customer_id", "customer_segment"), "customer_id")
           .groupBy("customer_segment").agg(F.sum("total_amount").alias("revenue")))
    return share_of_total(seg, "revenue")


def category_share(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """C9 by product category: completed line-revenue share."""
    from tillroll.plans.sales import completed_lines
    cat = (completed_lines(items, products, orders)
           .groupBy("category").agg(F.sum(line_revenue()).alias("revenue")))
    return share_of_total(cat, "revenue")


def status_distribution(orders: DataFrame) -> DataFrame:
    """Distinct orders per status with their percentage."""
    st = orders.groupBy("status").agg(F.countDistinct("order_id").alias("orders"))
    return share_of_total(st, "orders", "pct_of_orders")


def kpi_total_revenue(orders: DataFrame) -> DataFrame:
    """C11: SUM(total_amount) over all statuses."""
    return orders.agg(F.sum("total_amount").alias("total_revenue"))


def executive_kpis(orders: DataFrame, as_of) -> DataFrame:
    """Current-month KPIs (completed orders, month of ``as_of`` up to it)."""
    day = lit_date(as_of)
    cur = filters.between_days(completed(orders), "order_date", F.trunc(day, "month"), day)
    return (cur.agg(F.sum("total_amount").alias("revenue"),
                    F.countDistinct("order_id").alias("orders"),
                    F.countDistinct("customer_id").alias("customers"),
                    ratio(F.sum("total_amount"), F.count("total_amount")).alias("avg_order_value")))


def product_kpis(product_sales: DataFrame) -> DataFrame:
    """Units sold, products sold, line revenue and the average of the
    per-product profit margins (%), completed orders."""
    per_product = (completed(product_sales).groupBy("product_id")
                   .agg(F.sum("quantity").alias("units"),
                        F.sum(line_revenue()).alias("revenue"),
                        F.sum(line_cost()).alias("cost")))
    return per_product.agg(
        F.sum("units").alias("units_sold"),
        F.count(F.lit(1)).alias("products_sold"),
        F.sum("revenue").alias("revenue"),
        F.avg(ratio(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100.0).alias("avg_profit_margin_pct"))


def customer_kpis(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """C14: total customers, buying customers, revenue and orders per buyer."""
    total_customers = customers.select(F.count(F.lit(1))).scalar()
    return (completed(orders)
            .agg(F.countDistinct("customer_id").alias("buying_customers"),
                 F.sum("total_amount").alias("revenue"),
                 F.countDistinct("order_id").alias("orders"))
            .select(total_customers.alias("total_customers"), "buying_customers",
                    ratio(F.col("revenue"), F.col("buying_customers")).alias("revenue_per_customer"),
                    ratio(F.col("orders"), F.col("buying_customers")).alias("orders_per_customer")))


def region_total_sales(orders: DataFrame) -> DataFrame:
    """SUM(total_amount) per region, all statuses, descending."""
    return (orders.groupBy("region").agg(F.sum("total_amount").alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_last(), "region"))


def revenue_trend(orders: DataFrame) -> DataFrame:
    """SUM(total_amount) per order day, all statuses."""
    return (orders.groupBy(F.to_date("order_date").alias("order_date"))
            .agg(F.sum("total_amount").alias("revenue")).orderBy("order_date"))


def top_products_by_header_total(product_sales: DataFrame, n: int = 10) -> DataFrame:
    """C17: top n product names by the fanned-out header total (all statuses)."""
    return (product_sales.groupBy("product_name")
            .agg(F.sum("quantity").alias("units_sold"), F.sum("total_amount").alias("revenue"))
            .orderBy(F.col("revenue").desc_nulls_last(), "product_name").limit(n))


def product_details(product_sales: DataFrame) -> DataFrame:
    """Revenue, units, cost and profit per product, completed orders."""
    return (completed(product_sales)
            .groupBy("product_id", "product_name", "category")
            .agg(F.sum(line_revenue()).alias("revenue"), F.sum("quantity").alias("units_sold"),
                 F.sum(line_cost()).alias("cost"))
            .withColumn("profit", F.col("revenue") - F.col("cost")))


def category_trend(product_sales: DataFrame, grain: str = "month") -> DataFrame:
    """Completed line revenue and units per category per period."""
    return (completed(product_sales)
            .groupBy("category", F.date_trunc(grain, "order_date").cast("date").alias("period"))
            .agg(F.sum(line_revenue()).alias("revenue"), F.sum("quantity").alias("units_sold")))


def product_trend(product_sales: DataFrame, grain: str = "month") -> DataFrame:
    """Completed line revenue and units per product per period."""
    return (completed(product_sales)
            .groupBy("product_id", F.date_trunc(grain, "order_date").cast("date").alias("period"))
            .agg(F.sum(line_revenue()).alias("revenue"), F.sum("quantity").alias("units_sold")))


# The grains of the periodic sales feed (week starts Monday).
GRAINS = ("day", "week", "month")


def periodic_sales(orders: DataFrame, grains=GRAINS) -> DataFrame:
    """C20: completed orders and revenue per day, ISO week and month.

    The orders are shuffled once, by order; the periods are added up from one
    row per day.
    """
    of = {f"_{g}": lambda c, g=g: F.date_trunc(g, c["day"]).cast("date") for g in grains}
    days = distinct_per_level(completed(orders).select("order_id", F.to_date("order_date").alias("day"), "total_amount"),
                              "order_id", ["day"], of, ["total_amount"])
    periods = F.array(*[F.struct(F.lit(g).alias("grain"), F.date_trunc(g, F.col("day")).cast("date").alias("period"),
                                 F.col(f"_{g}").alias("n")) for g in grains])
    return (days.select("total_amount", F.inline(periods)).groupBy("grain", "period")
            .agg(F.sum("n").alias("orders"), F.sum("total_amount").alias("revenue")))


def cross_sell(items: DataFrame, anchors: DataFrame) -> DataFrame:
    """Products bought together with each anchor product.

    support = orders with both / all orders; confidence = orders with both /
    orders with the anchor; lift = confidence / (orders with the partner /
    all orders). Baskets are distinct (order, product) pairs; only pairs with
    an anchor are formed (see ``co_occurrence``), none are capped.
    """
    b = baskets(items)
    per_product = b.groupBy("product_id").agg(F.count(F.lit(1)).alias("product_orders"))
    total_orders = b.select(F.countDistinct("order_id")).scalar()
    pairs = co_occurrence(items, anchors)
    anchor_counts = per_product.select(F.col("product_id").alias("anchor_id"),
                                       F.col("product_orders").alias("anchor_orders"))
    return (pairs.join(anchor_counts, "anchor_id").join(per_product, "product_id")
            .select("anchor_id", "product_id", "pair_orders",
                    ratio(F.col("pair_orders"), total_orders).alias("support"),
                    ratio(F.col("pair_orders"), F.col("anchor_orders")).alias("confidence"),
                    ratio(ratio(F.col("pair_orders"), F.col("anchor_orders")),
                          ratio(F.col("product_orders"), total_orders)).alias("lift")))


def best_selling_product(items: DataFrame) -> DataFrame:
    """The product found in the most orders (ties: lowest id), as a one-row anchor frame."""
    b = baskets(items)
    top = (b.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
           .orderBy(F.col("n").desc(), "product_id").limit(1))
    return top.select("product_id")


def customer_lifetime_value(orders: DataFrame) -> DataFrame:
    """Completed revenue, orders, first / last order day and tenure per customer."""
    d = F.to_date("order_date")
    return (completed(orders).groupBy("customer_id")
            .agg(F.sum("total_amount").alias("lifetime_revenue"),
                 F.countDistinct("order_id").alias("orders"),
                 F.min(d).alias("first_order"), F.max(d).alias("last_order"))
            .withColumn("tenure_days", F.datediff("last_order", "first_order").cast("long")))


def order_frequency_distribution(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers per number of completed orders, zero included."""
    per_c = (completed(orders).groupBy("customer_id")
             .agg(F.countDistinct("order_id").alias("n")))
    return (customers.select("customer_id").join(per_c, "customer_id", "left")
            .groupBy(F.coalesce("n", F.lit(0)).cast("long").alias("orders_per_customer"))
            .agg(F.count(F.lit(1)).alias("customers")))


def signup_dates(orders: DataFrame) -> DataFrame:
    """customer_id -> signup_date, the day of the first order (any status)."""
    return orders.groupBy("customer_id").agg(F.min(F.to_date("order_date")).alias("signup_date"))


def customer_acquisition(customers_with_signup: DataFrame) -> DataFrame:
    """New customers per signup month and the running total.

    The running sum is a window over months (one row per month), which is
    bounded by the calendar, not by the data.
    """
    monthly = (customers_with_signup
               .groupBy(F.trunc("signup_date", "month").alias("signup_month"))
               .agg(F.count(F.lit(1)).alias("new_customers")))
    w = Window.orderBy("signup_month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly.withColumn("cumulative_customers", F.sum("new_customers").over(w))


def churn(customers: DataFrame, orders: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Per segment, customers whose last completed order is more than
    ``days`` before ``as_of`` (or who never completed one), and the rate."""
    last = (completed(orders).groupBy("customer_id")
            .agg(F.max(F.to_date("order_date")).alias("last_order")))
    flagged = (customers.select("customer_id", "customer_segment")
               .join(last, "customer_id", "left")
               .withColumn("churned", F.col("last_order").isNull()
                           | (F.col("last_order") <= F.date_sub(lit_date(as_of), days))))
    return (flagged.groupBy("customer_segment")
            .agg(F.count(F.lit(1)).alias("customers"), F.count_if("churned").alias("churned"))
            .withColumn("churn_rate_pct", pct(F.col("churned"), F.col("customers"))))


def rfm_segmentation(orders: DataFrame, customers: DataFrame, as_of) -> DataFrame:
    """Recency / frequency / monetary quintiles (5 = best) per buying customer.

    Quintiles are exact NTILE(5) over all buying customers, computed with the
    distributed global rank (ties broken by customer_id).
    """
    d = F.to_date("order_date")
    per_c = (completed(orders).groupBy("customer_id")
             .agg(F.max(d).alias("last_order"), F.countDistinct("order_id").alias("frequency"),
                  F.sum("total_amount").alias("monetary"))
             .withColumn("recency_days", F.datediff(lit_date(as_of), "last_order").cast("long"))
             .drop("last_order"))
    cid = F.col("customer_id")
    r = ntile_global(per_c, [F.col("recency_days").desc(), cid.desc()], 5, "r_score")
    f = ntile_global(r, [F.col("frequency").asc(), cid.asc()], 5, "f_score")
    m = ntile_global(f, [F.col("monetary").asc(), cid.asc()], 5, "m_score")
    return m.join(customers.select("customer_id", "customer_segment"), "customer_id", "left")


def geo_distribution(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Buying customers, orders and completed revenue by region and country."""
    o = completed(orders).select("customer_id", "order_id", "total_amount")
    c = customers.select("customer_id", "country", "region")
    return (o.join(c, "customer_id").groupBy("region", "country")
            .agg(F.countDistinct("customer_id").alias("customers"),
                 F.countDistinct("order_id").alias("orders"),
                 F.sum("total_amount").alias("revenue")))


# The funnel stages, in order.
FUNNEL = ("signup", "view", "click", "purchase")


def conversion_funnel(events: DataFrame, stages=FUNNEL) -> DataFrame:
    """Users reaching each stage in order, by the first time of each stage.

    A user reaches step k when the first occurrences of steps 1..k exist and
    are non-decreasing in time. One aggregation per user (partial
    aggregation absorbs a hot user) and one global aggregate.
    """
    firsts = events.groupBy("user_id").agg(*[
        F.min(F.when(F.col("event_type") == s, F.col("ts"))).alias(f"t{i}")
        for i, s in enumerate(stages)])
    reached = []
    cond = F.lit(True)
    for i in range(len(stages)):
        cond = cond & F.col(f"t{i}").isNotNull()
        if i > 0:
            cond = cond & (F.col(f"t{i}") >= F.col(f"t{i-1}"))
        reached.append(F.count_if(cond).alias(f"s{i}"))
    counts = firsts.agg(*reached)
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("step"), F.lit(s).alias("stage"),
                              F.col(f"s{i}").alias("users"),
                              F.col(f"s{i-1}" if i else "s0").alias("prev_users"),
                              F.col("s0").alias("first_users"))
                     for i, s in enumerate(stages)])
    return (counts.select(F.inline(rows))
            .select("step", "stage", "users",
                    pct(F.col("users"), F.col("prev_users")).alias("step_rate_pct"),
                    pct(F.col("users"), F.col("first_users")).alias("overall_rate_pct")))


# A result within 10 % below its target counts as "near".
NEAR_TARGET = 0.9


def target_status(actuals: DataFrame, targets: DataFrame, keys: list[str], measure: str,
                  target: str = "target") -> DataFrame:
    """Above / near / below target band for each actual."""
    r = ratio(F.col(measure), F.col(target))
    return (actuals.join(targets, keys, "left")
            .withColumn("target_status",
                        F.when(F.col(target).isNull(), None)
                        .when(r >= 1.0, "above").when(r >= NEAR_TARGET, "near").otherwise("below")))


def region_year_targets(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actual completed revenue per (region, year) and its target: the
    region's revenue of the previous year."""
    actual = (completed(orders)
              .groupBy("region", F.year("order_date").cast("long").alias("year"))
              .agg(F.sum("total_amount").alias("revenue")))
    targets = actual.select("region", (F.col("year") + 1).alias("year"),
                            F.col("revenue").alias("target"))
    return actual, targets


def color_scale(df: DataFrame, measure: str, name: str = "color_scale") -> DataFrame:
    """(x - min) / (max - min) with min / max as scalar subqueries."""
    lo = df.select(F.min(measure)).scalar()
    hi = df.select(F.max(measure)).scalar()
    return df.withColumn(name, ratio(F.col(measure) - lo, hi - lo))


def metric_alerts(orders: DataFrame, threshold) -> DataFrame:
    """(region, day) cells whose completed revenue reaches ``threshold``."""
    daily = (completed(orders)
             .groupBy("region", F.to_date("order_date").alias("order_date"))
             .agg(F.sum("total_amount").alias("revenue")))
    return daily.where(F.col("revenue") >= F.lit(threshold))


# The order statuses, in display order.
STATUSES = ("completed", "pending", "cancelled")


def pivot_sales(orders: DataFrame, statuses=STATUSES) -> DataFrame:
    """Header revenue with region rows and one column per status.

    The value list is explicit, so Spark skips the distinct-values job and
    the output schema is fixed.
    """
    return (orders.groupBy("region").pivot("status", list(statuses))
            .agg(F.sum("total_amount")))


def iso_weekday(d: Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return ((F.dayofweek(d) + 5) % 7 + 1).cast("long")


def heatmap_feed(orders: DataFrame) -> DataFrame:
    """Completed revenue and orders per (weekday, region) cell."""
    return (completed(orders)
            .groupBy(iso_weekday(F.col("order_date")).alias("weekday"), "region")
            .agg(F.sum("total_amount").alias("revenue"),
                 F.countDistinct("order_id").alias("orders")))
