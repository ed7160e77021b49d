"""Plan-shape checks: pushdown, pruning, top-k, bucketed joins, no
unpartitioned windows on raw rows."""

import contextlib
import io
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from tillroll.plans import sales
from tillroll.session import shared_dir
from tillroll.sources.star import load_star_tables


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_completed_status_is_pushed_into_orders_scan(spark):
    p = plan(E.queries()["a5_category_performance"](spark, SF001))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", p)


def test_scans_read_only_referenced_columns(spark):
    p = plan(E.queries()["a4_daily_sales"](spark, SF001))
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", p).group(1)
    assert "o_orderpriority" not in schema and "o_custkey" not in schema


def test_top_k_is_take_ordered(spark):
    p = plan(E.queries()["a2_top_products"](spark, SF001))
    assert "TakeOrderedAndProject" in p


def test_dedupe_and_share_use_no_window(spark):
    for key in ("v8_dedupe_items", "c9_segment_share", "c30_color_scale"):
        assert "Window" not in plan(E.queries()[key](spark, SF001)), key


def test_anomaly_window_is_partitioned_by_series(spark):
    p = plan(E.queries()["m2_revenue_anomalies"](spark, SF001))
    assert re.search(r"Window \[.*\], \[region#\d+\]", p)


def test_bucketed_star_join_needs_no_exchange(spark):
    st = load_star_tables(spark, SF001, shared_dir(spark, "test-star"), buckets=4, db="tillroll_test_star")
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(st.order_items.join(st.orders.where(F.col("status") == "completed"), "order_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "SortMergeJoin" in p
    assert "Exchange" not in p


def test_loaded_star_region_query_has_no_customer_join(spark):
    st = load_star_tables(spark, SF001, shared_dir(spark, "test-star2"))
    p = plan(sales.sales_by_region(st.orders))
    assert "Join" not in p
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(status_code,F\)", p)


def test_month_partitioned_star_prunes_and_matches(spark):
    from tillroll.operators import filters as FL
    from tillroll.plans import metrics as M
    from tillroll.sources import testdata as td
    st = load_star_tables(spark, SF001, shared_dir(spark, "test-star-month"), by_month=True)
    recent = FL.last_days(st.orders, "order_date", "2001-06-30", 90)
    p = plan(recent)
    assert re.search(r"PartitionFilters: \[[^\]]*order_month", p)
    q = sales.category_performance(st.order_items, st.products, recent)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # keep the join a shuffle join
    try:
        assert "dynamicpruning" in plan(q).lower()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    raw = td.load_star(spark, SF001)
    want = sales.category_performance(raw.order_items, raw.products,
                                      FL.last_days(raw.orders, "order_date", "2001-06-30", 90))
    assert sorted(map(tuple, q.collect())) == sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, M.yoy_growth(st.orders).collect())) == sorted(map(tuple, M.yoy_growth(raw.orders).collect()))


def test_open_star_reads_back_the_loaded_tables(spark):
    from tillroll.sources.star import open_star
    root = shared_dir(spark, "test-star-open")
    st = load_star_tables(spark, SF001, root)
    again = open_star(spark, root)
    for t in ("orders", "order_items", "customers", "products"):
        assert getattr(again, t).count() == getattr(st, t).count()
    assert sorted(map(tuple, sales.sales_by_region(again.orders).collect())) == \
        sorted(map(tuple, sales.sales_by_region(st.orders).collect()))


def test_date_bounds_reach_the_scan(spark):
    from tillroll.operators import filters
    df = filters.between_dates(spark.read.parquet(f"{SF001}/orders.parquet"), "o_orderdate", "1995-01-01", "1995-02-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(o_orderdate" in pushed and "LessThan(o_orderdate" in pushed


def test_session_keeps_given_settings(tmp_path):
    """What spark-submit gives survives build_session."""
    import os
    import subprocess
    import sys
    from pathlib import Path
    code = ("from tillroll.session import build_session; s = build_session(); "
            "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.files.maxPartitionBytes'))")
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parents[1]), "PYSPARK_SUBMIT_ARGS":
                        "--master local[1] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=20000 "
                        "--conf spark.sql.files.maxPartitionBytes=256m pyspark-shell"}
    got = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "GOT 20000 256m" in got.stdout, got.stderr[-2000:]
