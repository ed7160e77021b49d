"""Filter and parameter boundaries (F1-F4, F8-F11) on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import filters as FL


def _orders(spark):
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    return spark.createDataFrame([(i, d, 50.0 * i, "completed" if i % 2 else "pending", "EU" if i % 3 else "US")
                                  for i, d in enumerate(days)],
                                 "order_id long, order_date timestamp_ntz, total_amount double, status string, region string")


def _days(df):
    return sorted(r[0] for r in df.select(F.to_date("order_date")).collect())


def test_last_days_is_n_days_ending_on_as_of(spark):
    got = _days(FL.last_days(_orders(spark), "order_date", "2024-03-01", 7))
    assert got[0] == dt.date(2024, 2, 24) and got[-1] == dt.date(2024, 3, 1) and len(got) == 7


def test_periods(spark):
    o = _orders(spark)
    last_q = _days(FL.in_period(o, "order_date", "2024-04-10", "quarter", -1))
    assert last_q[0] == dt.date(2024, 1, 1) and last_q[-1] == dt.date(2024, 3, 31)
    this_m = _days(FL.in_period(o, "order_date", "2024-02-10", "month", 0))
    assert this_m[0] == dt.date(2024, 2, 1) and this_m[-1] == dt.date(2024, 2, 29)


def test_between_dates_is_half_open(spark):
    got = _days(FL.between_dates(_orders(spark), "order_date", "2024-01-10", "2024-01-12"))
    assert got == [dt.date(2024, 1, 10), dt.date(2024, 1, 11)]


def test_filter_in_and_thresholds(spark):
    o = _orders(spark)
    assert FL.filter_in(o, "region", ["US"]).count() == 40
    assert FL.orders_at_least(o, 100).agg(F.min("total_amount")).first()[0] == 100.0
    assert FL.orders_at_least(o).count() == 118
    prod = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "product_id string, revenue double")
    assert [r[0] for r in FL.products_above(prod, 20).collect()] == ["b"]


def test_row_and_column_security(spark):
    o = _orders(spark)
    grants = spark.createDataFrame([("ana", "EU"), ("bob", "US")], "user string, region string")
    assert FL.rows_for(o, grants, "bob").count() == 40
    assert FL.rows_for(o, grants, "nobody").count() == 0
    c = spark.createDataFrame([(1, "Ann", "ann@x")], "customer_id long, name string, email string")
    h = FL.hide_columns(c, drop=["email"], hash_cols=["name"]).first()
    assert h.asDict().keys() == {"customer_id", "name"} and len(h["name"]) == 64
