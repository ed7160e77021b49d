"""Catalog: streaming T1-T4.

The live feeds run as availableNow streams over the driver tables into a
Parquet sink under the shared checkpoint folder and are read back. In
append mode the windows still open when the input ends (end later than
the last event time minus the 1-hour watermark) are not emitted yet; the
oracles leave exactly those out.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tillroll.catalog.common import oracle, out
from tillroll.catalog.ingest_entries import BATCHES, ITEMS_TD, land, landing_files
from tillroll.session import shared_dir
from tillroll.sources import ingest as I
from tillroll.sources import testdata as td
from tillroll.streaming import live


def _run(spark, df, name):
    root = shared_dir(spark, name)
    live.run_to_parquet(df, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def _t1(spark, sf):
    root = shared_dir(spark, "t1")
    items = td.order_items(spark, sf)
    files = landing_files(items)
    src = land(items, f"{root}/landing/order_items", files=files)
    store = I.Store(f"{root}/store")
    I.ingest(spark, "order_items", src, store, schema=ITEMS_TD, max_files=math.ceil(files / BATCHES))
    I.ingest(spark, "order_items", src, store, schema=ITEMS_TD)
    return out(I.loaded(spark, store, "order_items").drop("batch_id"))


T1_SQL = oracle("""SELECT order_id, product_id, CAST(line_number AS BIGINT) AS line_number,
       CAST(quantity AS BIGINT) AS quantity, CAST(line_amount AS DOUBLE) AS line_amount,
       CAST(discount AS DOUBLE) AS discount FROM star_items""")


def _t2(spark, sf):
    return out(_run(spark, live.live_orders(live.orders_stream(spark, sf), "1 day"), "t2"))


T2_SQL = oracle("""
SELECT date_trunc('day', order_date) AS window_start, date_trunc('day', order_date) + INTERVAL 1 DAY AS window_end,
       status, COUNT(*) AS orders, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain GROUP BY 1, 2, 3
HAVING date_trunc('day', order_date) + INTERVAL 1 DAY
       <= (SELECT MAX(order_date) FROM star_orders_plain) - INTERVAL 1 HOUR""")


def _t3(spark, sf):
    r = _run(spark, live.live_traffic(live.stream_table(spark, sf, "events"), "1 hour"), "t3")
    # A DOUBLE sum depends on the order of addition; compare at 6 decimals.
    return r.withColumn("value", F.round("value", 6))


T3_SQL = """
SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS events, ROUND(SUM(value), 6) AS value
FROM events GROUP BY 1, 2, 3
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR"""


def _t4(spark, sf):
    return _run(spark, live.live_alerts(live.stream_table(spark, sf, "events"), "1 day", limit=60), "t4")


T4_SQL = """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type, COUNT(*) AS events
FROM events WHERE event_type = 'error' GROUP BY 1, 2, 3
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR
   AND COUNT(*) >= 60"""

FEEDS = {  # feed -> (table, id, time, width, DuckDB: key column, row filter, sums)
    "orders": (live.orders_feed("1 day"), "star_orders_plain", "order_id", "order_date", "day", "status", "TRUE"),
    "traffic": (live.traffic_feed("1 hour"), "events", "event_id", "ts", "hour", "event_type", "TRUE"),
    "alerts": (live.alerts_feed("1 day", limit=40), "events", "event_id", "ts", "day", "event_type", "event_type = 'error'"),
}


def _arrivals(spark, sf, name):
    """The feed's table as two deliveries: every third row by id comes after all the others, and mostly too late."""
    feed, _, key, *_ = FEEDS[name]
    rows = td.orders_plain(spark, sf) if name == "orders" else td.events(spark, sf)
    root = shared_dir(spark, f"arrivals-{name}")
    for k, part in enumerate((rows.where(F.col(key) % 3 != 0), rows.where(F.col(key) % 3 == 0))):
        part.coalesce(1).write.parquet(f"{root}/landing/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/landing/*")
    live.run_counted(stream, feed, f"{root}/out")
    return stream, feed, f"{root}/out"


def _late(name):
    def run(spark, sf):
        return out(live.late_rows(*_arrivals(spark, sf, name)))
    return run


def _counted(name):
    def run(spark, sf):
        return out(live.closed_windows(*_arrivals(spark, sf, name)))
    return run


def _balance(spark, sf):
    """Closed, late, open and read rows of the three feeds."""
    parts = []
    for name, (feed, *_rest) in FEEDS.items():
        stream, feed, root = _arrivals(spark, sf, name)
        parts.append(live.balance(stream, feed, root).select(F.lit(name).alias("feed"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("read", F.expr("closed + late + open"))


def _rows_sql(name):
    """Rows of a feed with their window and whether they came late."""
    _, table, key, ts, unit, by, where = FEEDS[name]
    end = f"date_trunc('{unit}', {ts}) + INTERVAL 1 {unit}"
    return f"""SELECT *, date_trunc('{unit}', {ts}) AS window_start, {end} AS window_end,
  {key} % 3 = 0 AND {end} <= (SELECT MAX({ts}) FROM {table} WHERE {where} AND {key} % 3 <> 0) - INTERVAL 1 HOUR AS late,
  {end} <= (SELECT MAX({ts}) FROM {table} WHERE {where}) - INTERVAL 1 HOUR AS shut FROM {table} WHERE {where}"""


BALANCE_SQL = oracle("\nUNION ALL\n".join(
    f"""SELECT '{name}' AS feed, COUNT(*) FILTER (WHERE shut AND NOT late) AS closed, COUNT(*) FILTER (WHERE late) AS late,
       COUNT(*) FILTER (WHERE NOT shut AND NOT late) AS open, COUNT(*) AS read FROM ({_rows_sql(name)}) r""" for name in FEEDS))
T2C_SQL = oracle(f"""SELECT window_start, window_end, status, COUNT(*) AS orders, CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM ({_rows_sql("orders")}) r WHERE shut AND NOT late GROUP BY 1, 2, 3""")
T2L_SQL = T2C_SQL.replace("shut AND NOT late", "late")
T4C_SQL = f"""SELECT window_start, window_end, event_type, COUNT(*) AS events
FROM ({_rows_sql("alerts")}) r WHERE shut AND NOT late GROUP BY 1, 2, 3 HAVING COUNT(*) >= 40"""

ENTRIES = {
    "t2_orders_counted": (_counted("orders"), T2C_SQL),
    "t2_late_orders": (_late("orders"), T2L_SQL),
    "t4_alerts_counted": (_counted("alerts"), T4C_SQL),
    "t_live_balance": (_balance, BALANCE_SQL),
    "t1_file_arrival_ingest": (_t1, T1_SQL),
    "t2_live_orders": (_t2, T2_SQL),
    "t3_live_traffic": (_t3, T3_SQL),
    "t4_live_alerts": (_t4, T4_SQL),
}
