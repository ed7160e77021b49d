"""Property tests over the driver test data and generated inputs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF001
from tillroll.functions.columns import completed
from tillroll.operators import quality, ranking
from tillroll.plans import drilldown, metrics as M, sales
from tillroll.operators import joins
from tillroll.sources import testdata as td


@pytest.fixture(scope="module")
def star(spark):
    return td.load_star(spark, SF001)


def test_profit_is_revenue_minus_cost(star):
    for r in sales.category_performance(star.order_items, star.products, star.orders).collect():
        assert r["profit"] == r["revenue"] - r["cost"]


def test_shares_sum_to_100(star):
    total = M.segment_share(star.orders, star.customers).agg(F.sum("share_pct")).first()[0]
    assert total == pytest.approx(100.0)


def test_regions_sum_to_total(star):
    by_region = sales.sales_by_region(star.orders).agg(F.sum("total_revenue")).first()[0]
    total = completed(star.orders).agg(F.sum("total_amount")).first()[0]
    assert by_region == total


def test_rollup_grand_total_equals_plain_total(star):
    owc = joins.orders_with_customers(star.orders, star.customers)
    d = drilldown.geo_drilldown(owc)
    grand = d.where(F.col("level") == 3).first()
    total = completed(star.orders).agg(F.sum("total_amount"), F.countDistinct("order_id")).first()
    assert grand["revenue"] == total[0] and grand["orders"] == total[1]
    regions = d.where(F.col("level") == 1).agg(F.sum("revenue")).first()[0]
    assert regions == total[0]


def test_dedupe_keys_unique_and_complete(star):
    d = quality.dedupe(star.order_items, ["order_id", "line_number"], ["product_id"])
    assert d.count() == star.order_items.select("order_id", "line_number").distinct().count()
    assert quality.check_unique(d, ["order_id", "line_number"]).count() == 0


def test_validate_partitions_input(star):
    rules = {"big": F.col("total_amount") < 300000, "done": F.col("status") == "completed"}
    good, bad = quality.validate(star.orders, rules)
    assert good.count() + bad.count() == star.orders.count()
    assert bad.where(F.size("reasons") == 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_global_rank_matches_row_number(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.randint(0, 30)) for i in range(rnd.randint(1, 400))]
    df = spark.createDataFrame(rows, "id long, v long")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = ranking.global_rank(df, order, "r", partitions=7, total="n")
    w = Window.orderBy(*order)
    want = df.withColumn("r", F.row_number().over(w))
    assert sorted(map(tuple, got.select("id", "r").collect())) == sorted(map(tuple, want.select("id", "r").collect()))
    assert {r[0] for r in got.select("n").distinct().collect()} == {len(rows)}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 13, 99])
def test_ntile_formula_matches_sql(spark, n):
    df = spark.range(n).withColumnRenamed("id", "x")
    want = df.withColumn("t", F.ntile(5).over(Window.orderBy("x")))
    got = ranking.ntile_global(df, [F.col("x")], 5, "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_top_percent_size(spark):
    df = spark.createDataFrame([(i, float(i % 17)) for i in range(101)], "customer_id long, revenue double")
    top = ranking.top_percent(df, "revenue", 0.2, ["customer_id"])
    assert top.count() == 21
    assert top.agg(F.min("revenue")).first()[0] >= df.orderBy(F.desc("revenue")).collect()[20]["revenue"]


def test_funnel_is_monotone(spark):
    f = M.conversion_funnel(td.events(spark, SF001)).orderBy("step").collect()
    users = [r["users"] for r in f]
    assert users == sorted(users, reverse=True)


def test_yoy_gap_year_gives_null(spark):
    o = spark.createDataFrame([(1, "2019-03-01", 100.0, "completed"), (2, "2021-03-01", 150.0, "completed"),
                               (3, "2022-03-01", 300.0, "completed")],
                              "order_id long, d string, total_amount double, status string") \
        .withColumn("order_date", F.to_timestamp("d"))
    got = {r["year"]: r for r in M.yoy_growth(o).collect()}
    assert got[2021]["prev_revenue"] is None and got[2021]["yoy_growth_pct"] is None
    assert got[2022]["yoy_growth_pct"] == pytest.approx(100.0)


def test_zero_revenue_ratio_is_null(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0)], "category string, revenue double, cost double")
    assert M.profit_margin_pct(df).first()["profit_margin_pct"] is None


def test_top_n_ties_are_broken_by_name(spark):
    df = spark.createDataFrame([(f"p{i:02d}", 10.0) for i in range(12)], "product_name string, revenue double")
    got = [r[0] for r in ranking.top_n(df, "revenue", 10, ["product_name"]).collect()]
    assert got == [f"p{i:02d}" for i in range(10)]


def test_customer_segments_equals_literal_left_join_under_skew(spark):
    """A hot customer with a third of the orders, a customer with only
    pending orders, a customer without orders, and an order with NULL status."""
    rnd = random.Random(7)
    cust = [(i, ["premium", "standard", "enterprise"][i % 3]) for i in range(60)]
    orders = []
    for oid in range(3000):
        cid = 0 if oid % 3 == 0 else rnd.randint(1, 50)
        st = rnd.choice(["completed", "completed", "pending", "cancelled"])
        orders.append((oid, cid, float(rnd.randint(1, 500)), st))
    orders += [(5000, 51, 10.0, "pending"), (5001, 52, 20.0, None)]
    c = spark.createDataFrame(cust, "customer_id long, customer_segment string")
    o = spark.createDataFrame(orders, "order_id long, customer_id long, total_amount double, status string")
    c.createOrReplaceTempView("skew_c")
    o.createOrReplaceTempView("skew_o")
    want = spark.sql("""
        SELECT c.customer_segment, COUNT(DISTINCT c.customer_id) AS customer_count,
               COUNT(DISTINCT o.order_id) AS total_orders, SUM(o.total_amount) AS total_revenue
        FROM skew_c c LEFT JOIN skew_o o ON c.customer_id = o.customer_id
        WHERE o.status = 'completed' OR o.status IS NULL GROUP BY 1""")
    got = sales.customer_segments(c, o).select("customer_segment", "customer_count", "total_orders", "total_revenue")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_orphans_with_repeated_parent_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    parent = spark.createDataFrame([(1,)] * 500 + [(3,)], "k long")
    assert [r[0] for r in quality.orphans(child, parent, "k").collect()] == [2]
