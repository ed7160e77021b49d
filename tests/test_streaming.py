"""Streaming: event-time conversion, closed-window parity with batch,
time-zone independence, stream dedupe."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import SF001
from tillroll.session import shared_dir
from tillroll.sources import testdata as td
from tillroll.streaming import live


def test_event_time_round_trip(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),), (dt.datetime(1999, 12, 31, 23, 59, 59),)],
                               "ts timestamp_ntz")
    back = df.select(live.wall_clock(live.event_time(F.col("ts"))).alias("b"), "ts").collect()
    assert all(r["b"] == r["ts"] for r in back)


def _run(spark, df, name):
    root = shared_dir(spark, name)
    live.run_to_parquet(df, f"{root}/out", f"{root}/ckpt")
    return spark.read.parquet(f"{root}/out")


def test_live_traffic_matches_batch_on_closed_windows(spark):
    got = _run(spark, live.live_traffic(live.stream_table(spark, SF001, "events"), "1 day"), "test-t3")
    ev = td.events(spark, SF001)
    last = ev.agg(F.max("ts")).first()[0]
    want = (ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"))
            .where(F.col("window_start") + F.expr("INTERVAL 1 DAY") <= F.lit(last - dt.timedelta(hours=1))))
    assert sorted(map(tuple, got.select("window_start", "event_type", "events").collect())) == \
        sorted(map(tuple, want.collect()))


def test_windows_do_not_depend_on_session_time_zone(spark):
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        la = _run(spark, live.live_orders(live.orders_stream(spark, SF001), "1 day"), "test-t2-la")
        la_rows = sorted(map(tuple, la.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    utc = _run(spark, live.live_orders(live.orders_stream(spark, SF001), "1 day"), "test-t2-utc")
    assert la_rows == sorted(map(tuple, utc.collect()))
    assert all(r[0].hour == 0 for r in la_rows)


def test_alerts_only_windows_over_limit(spark):
    got = _run(spark, live.live_alerts(live.stream_table(spark, SF001, "events"), "1 day", limit=8), "test-t4")
    assert got.count() > 0
    assert got.where(F.col("events") < 8).count() == 0


def test_stream_dedupe(spark):
    ev = live.stream_table(spark, SF001, "events")
    doubled = ev.unionByName(live.stream_table(spark, SF001, "events"))
    got = _run(spark, live.dedupe_stream(doubled, ["event_id"], "ts"), "test-dedupe")
    assert got.count() == td.events(spark, SF001).count()


def test_live_orders_follow_ingested_files(spark):
    """Landing files -> ingest -> live windows over the loaded orders."""
    import os

    from tests.sample import ORDERS, csv_text
    from tillroll.session import local_path
    from tillroll.sources import ingest as I
    root = shared_dir(spark, "test-live-store")
    land, store = f"{root}/landing/orders", I.Store(f"{root}/store")
    os.makedirs(local_path(land), exist_ok=True)
    header = "order_id,customer_id,order_date,total_amount,status,region"
    with open(f"{local_path(land)}/a.csv", "w") as f:
        f.write(csv_text(header, ORDERS))
    I.ingest(spark, "orders", land, store)
    out = f"{root}/live"
    feed = live.live_orders(live.loaded_orders_stream(spark, store.root), "1 day")
    live.run_to_parquet(feed, f"{out}/o", f"{out}/c")
    got = {(str(r["window_start"].date()), r["status"]): r["orders"]
           for r in spark.read.parquet(f"{out}/o").collect()}
    # the last day (2024-01-18) is still open under the watermark
    assert got == {("2024-01-15", "completed"): 3, ("2024-01-16", "completed"): 2,
                   ("2024-01-16", "pending"): 1, ("2024-01-17", "completed"): 2,
                   ("2024-01-17", "cancelled"): 1}


def test_table_of_many_files_streams_whole(spark):
    """A table written as a folder of part files gives the same windows as the single file."""
    root = shared_dir(spark, "test-parts")
    spark.read.parquet(f"{SF001}/events.parquet").repartition(5).write.parquet(f"{root}/sf/events.parquet")
    one = _run(spark, live.live_traffic(live.stream_table(spark, SF001, "events"), "1 day"), "test-one")
    many = _run(spark, live.live_traffic(live.stream_table(spark, f"{root}/sf", "events"), "1 day"), "test-many")
    cols = ["window_start", "event_type", "events"]
    assert sorted(map(tuple, one.select(cols).collect())) == sorted(map(tuple, many.select(cols).collect()))


def test_daily_windows_count_backfill(spark):
    """The newer load first, the older one after: every loaded order is counted."""
    import os

    from tests.sample import ORDERS, csv_text
    from tillroll.session import local_path
    from tillroll.sources import ingest as I
    root = shared_dir(spark, "test-backfill")
    land, store = f"{root}/landing/orders", I.Store(f"{root}/store")
    os.makedirs(local_path(land), exist_ok=True)
    header = "order_id,customer_id,order_date,total_amount,status,region"
    lines = csv_text(header, ORDERS).strip().split("\n")
    for name, part in (("new", lines[6:]), ("old", lines[1:6])):
        with open(f"{local_path(land)}/{name}.csv", "w") as f:
            f.write("\n".join([lines[0], *part]) + "\n")
        I.ingest(spark, "orders", land, store)
        live.run_daily(spark, store.root, f"{root}/daily", f"{root}/checkpoint")
    got = spark.read.parquet(f"{root}/daily").agg({"orders": "sum"}).first()[0]
    assert got == len(lines) - 1 == I.loaded(spark, store, "orders").count()


def _files(spark, rows, ddl, name):
    """Rows as a file stream, one file per list, in that order."""
    import time
    path = shared_dir(spark, name)
    for k, part in enumerate(rows):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(f"{path}/{k}")
        time.sleep(0.05)
    return (spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")), [r for p in rows for r in p]


def _t(h, m=0, day=1):
    return dt.datetime(2024, 5, day, h, m)


def test_late_rows_are_counted(spark):
    """Closed, late and open add up to the rows read, for all three feeds; a late burst is in the side table."""
    ddl = "ts timestamp_ntz, event_type string, value double, order_date timestamp_ntz, status string, total_amount decimal(12,2)"
    row = lambda t, e="error", v=1.0: (t, e, v, t, "completed" if e == "error" else "pending", Decimal(2))
    rows = [[row(_t(1, 5)), row(_t(1, 6), "view"), row(_t(2, 0)), row(None)],
            [row(_t(5)), row(_t(1, 7))],                         # 01:07 is in time: its window had not closed before this batch
            [row(_t(1, 8)), row(_t(1, 9)), row(_t(5, 1)), row(_t(3))],   # 01 and 03 have closed
            [row(_t(9, day=3))], [row(_t(5, 2))]]
    for k, (feed, step) in enumerate([(live.traffic_feed(), None), (live.alerts_feed(limit=3), "error"), (live.orders_feed("1 hour"), None)]):
        stream, all_rows = _files(spark, rows, ddl, f"test-late-{k}")
        root = shared_dir(spark, f"test-late-out-{k}")
        live.run_counted(stream, feed, root)
        read = len([r for r in all_rows if step is None or r[1] == step])
        b = live.balance(stream, feed, root).first()
        assert b["closed"] + b["late"] + b["open"] == read and b["late"] == 5 and b["open"] == 1
        late = {(r["window_start"] and r["window_start"].hour): r[feed.rows] for r in live.late_rows(stream, feed, root).collect()}
        assert late == {None: 1, 1: 2, 3: 1, 5: 1}
        closed = live.closed_windows(stream, feed, root)
        assert closed.groupBy("window_start", *feed.keys).count().where("count > 1").count() == 0
        if k == 0:
            got = {(r["window_start"].hour, r["event_type"]): (r["events"], r["value"]) for r in closed.collect()}
            assert got == {(1, "error"): (2, 2.0), (1, "view"): (1, 1.0), (2, "error"): (1, 1.0), (5, "error"): (2, 2.0)}
        if k == 1:
            assert closed.count() == 0                            # the late burst has not raised the alert, and is counted


def test_counted_windows_equal_the_native_ones(spark):
    stream = live.stream_table(spark, SF001, "events")
    root = shared_dir(spark, "test-counted")
    live.run_counted(stream, live.traffic_feed("1 day"), root)
    got = live.closed_windows(stream, live.traffic_feed("1 day"), root)
    want = _run(spark, live.live_traffic(live.stream_table(spark, SF001, "events"), "1 day"), "test-native")
    cols = ["window_start", "window_end", "event_type", "events"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    live.run_counted(stream, live.traffic_feed("1 day"), root)     # nothing new: nothing changes
    assert live.closed_windows(stream, live.traffic_feed("1 day"), root).count() == want.count()


def test_counted_windows_of_an_empty_stream(spark):
    ddl = "ts timestamp_ntz, event_type string, value double"
    stream, _ = _files(spark, [[]], ddl, "test-none")
    root = shared_dir(spark, "test-none-out")
    live.run_counted(stream, live.traffic_feed(), root)
    assert live.closed_windows(stream, live.traffic_feed(), root).count() == 0
    assert tuple(live.balance(stream, live.traffic_feed(), root).first()) == (0, 0, 0)
