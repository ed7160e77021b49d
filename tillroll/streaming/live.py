"""Live dashboards as Structured Streaming queries.

Each feed is an event-time tumbling-window aggregate with a watermark
(1 hour by default) in append mode: a window is emitted once the watermark
passes its end and its state is dropped, so state stays bounded however
long the stream runs; events later than the watermark are ignored, and nothing
says how many. The state is keyed by (window, key) and partitioned by it across
the state store, with partial aggregation before the shuffle.

``run_counted`` computes the same windows without losing a row unseen: what
comes after its window has closed is counted per window in a side table, so
that rows emitted, late and still open add up to the rows read (``balance``).

Event times in the tables are wall-clock TIMESTAMP_NTZ; watermarks need an
instant, so ``event_time`` maps the wall clock to the instant with the same
UTC reading (pure arithmetic, independent of the session time zone) and
``wall_clock`` maps window bounds back.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.session import child_names, delete_path, path_is_file
from tillroll.sources.testdata import MONEY, status_name

WATERMARK = "1 hour"


def event_time(ntz: Column) -> Column:
    """TIMESTAMP_NTZ wall clock -> TIMESTAMP instant at the same UTC reading."""
    days = F.datediff(F.to_date(ntz), F.lit("1970-01-01").cast("date")).cast("long")
    secs = days * 86400 + F.hour(ntz) * 3600 + F.minute(ntz) * 60
    micros = secs * 1_000_000 + (F.extract(F.lit("SECOND"), ntz) * 1_000_000).cast("long")
    return F.timestamp_micros(micros)


def wall_clock(instant: Column) -> Column:
    """TIMESTAMP instant -> TIMESTAMP_NTZ with its UTC reading."""
    micros = F.unix_micros(instant)
    days = F.floor(micros / 86_400_000_000).cast("int")
    rem = micros - days.cast("long") * 86_400_000_000
    secs = (rem / F.lit(1_000_000)).cast("decimal(18,6)")
    base = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return base + F.make_dt_interval(days, F.lit(0), F.lit(0), secs)


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test-data table as a file stream, whether it is one file or a folder of part files."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if path_is_file(spark, path):  # a stream reads folders
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return source.parquet(path)


def loaded_orders_stream(spark: SparkSession, store_root: str) -> DataFrame:
    """The orders loaded by ``sources.ingest`` as a stream: each load batch
    adds files under ``tables/orders/batch_id=N``, which the file source
    picks up once."""
    from pyspark.sql import types as T

    from tillroll.schemas import ORDERS
    schema = T.StructType(list(ORDERS.fields) + [T.StructField("batch_id", T.IntegerType())])
    return spark.readStream.schema(schema).parquet(f"{store_root.rstrip('/')}/tables/orders")


def orders_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = stream_table(spark, sf_dir, "orders")
    return o.select(o.o_orderkey.alias("order_id"), o.o_orderdate.alias("order_date"),
                    o.o_totalprice.cast(MONEY).alias("total_amount"),
                    status_name(o.o_orderstatus).alias("status"))


@dataclass
class Feed:
    """A windowed feed: event time, window width, keys, and sums and counts
    that add up over partial results; ``least`` keeps the closed windows whose
    measure reaches a limit (alerts)."""
    ts: str
    width: str
    keys: list[str]
    sums: dict[str, str | None]   # measure -> summed column, None for a count of rows
    rows: str                     # the measure that counts rows
    only: tuple[str, str] | None = None   # column and the value it must have
    least: tuple[str, int] | None = None


def orders_feed(width: str = "1 day") -> Feed:
    """T2 as a feed."""
    return Feed("order_date", width, ["status"], {"orders": None, "revenue": "total_amount"}, "orders")


def traffic_feed(width: str = "1 hour") -> Feed:
    """T3 as a feed."""
    return Feed("ts", width, ["event_type"], {"events": None, "value": "value"}, "events")


def alerts_feed(width: str = "1 hour", limit: int = 10, event_type: str = "error") -> Feed:
    """T4 as a feed."""
    return Feed("ts", width, ["event_type"], {"events": None}, "events", ("event_type", event_type), ("events", limit))


def _partial(batch: DataFrame, feed: Feed) -> DataFrame:
    """A micro-batch per window and key. Rows of null event time belong to no window: their window is null."""
    rows = batch if feed.only is None else batch.where(F.col(feed.only[0]) == feed.only[1])
    w = F.window(event_time(F.col(feed.ts)), feed.width)
    aggs = [(F.count(F.lit(1)) if c is None else F.sum(c)).alias(m) for m, c in feed.sums.items()]
    timed = rows.where(F.col(feed.ts).isNotNull()).groupBy(w.alias("w"), *feed.keys).agg(*aggs, F.max(event_time(F.col(feed.ts))).alias("newest"))
    untimed = rows.where(F.col(feed.ts).isNull()).groupBy(*feed.keys).agg(*aggs)
    return (timed.select("w.start", "w.end", *feed.keys, *feed.sums, "newest")
            .unionByName(untimed.select(F.lit(None).cast("timestamp").alias("start"), F.lit(None).cast("timestamp").alias("end"),
                                        *feed.keys, *feed.sums, F.lit(None).cast("timestamp").alias("newest"))))


def _batch_ids(spark: SparkSession, path: str) -> list[int]:
    return [int(n[9:]) for n in child_names(spark, path) if n.startswith("batch_id=")]


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batch folders of a path."""
    return spark.read.schema(schema).parquet(path).select(*schema.names) if _batch_ids(spark, path) else spark.createDataFrame([], schema)


def run_counted(stream: DataFrame, feed: Feed, root: str, delay: str = WATERMARK, states_kept: int = 2) -> None:
    """Run a feed to completion over the available input, counting late rows.

    Folders under ``root``, each written per micro-batch (a batch run again
    replaces its own, so the results are exactly once):

        closed/   windows that have closed, each written once
        late/     rows per window that came after it had closed, or without event time
        open/     partial sums of the windows still open, and the newest event time seen

    A window closes when the newest event time of the batches so far, less the
    delay, has passed its end. A row is late when its window had closed before
    its batch. State is the open windows alone: one row per window and key.
    """
    spark = stream.sparkSession
    part = _partial(spark.createDataFrame([], stream.schema), feed).schema  # the shape of the partial sums

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        got = _partial(batch, feed)
        last = max((b for b in _batch_ids(spark, f"{root}/open") if b < n), default=None)
        held = spark.createDataFrame([], part) if last is None else spark.read.schema(part).parquet(f"{root}/open/batch_id={last}")
        # the mark row: a window of no keys that carries the newest event time of all batches before
        mark = held.where("start is null").agg(F.max("newest")).first()[0]
        line = lambda t: F.lit(t).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        shut = F.col("end") <= line(mark) if mark is not None else F.lit(False)
        late = got.where(F.col("end").isNull() | shut)
        fresh = got.where(F.col("end").isNotNull() & ~shut)
        sums = [F.sum(m).cast(part[m].dataType).alias(m) for m in feed.sums]
        state = (held.where("start is not null").unionByName(fresh).groupBy("start", "end", *feed.keys)
                 .agg(*sums, F.max("newest").alias("newest")))
        at = lambda name: f"{root}/{name}/batch_id={n}"
        late.drop("newest").write.mode("overwrite").parquet(at("late"))
        state.write.mode("overwrite").parquet(at("merged"))
        state = spark.read.schema(part).parquet(at("merged"))
        newest = state.agg(F.max("newest")).first()[0]
        newest = max([t for t in (mark, newest) if t is not None], default=None)
        done = F.col("end") <= line(newest) if newest is not None else F.lit(False)
        state.where(done).drop("newest").write.mode("overwrite").parquet(at("closed"))
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in part.fields if f.name != "newest"]
        marked = spark.range(1).select(*empty, F.lit(newest).cast("timestamp").alias("newest"))
        # written last: the next batch starts from it
        state.where(~done).unionByName(marked).write.mode("overwrite").parquet(at("open"))
        delete_path(spark, at("merged"))
        for b in _batch_ids(spark, f"{root}/open"):
            if b <= n - states_kept:
                delete_path(spark, f"{root}/open/batch_id={b}")

    (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def _shape(stream: DataFrame, feed: Feed) -> T.StructType:
    spark = stream.sparkSession
    return _partial(spark.createDataFrame([], stream.schema), feed).drop("newest").schema


def _named(df: DataFrame, feed: Feed) -> DataFrame:
    return df.select(wall_clock(F.col("start")).alias("window_start"), wall_clock(F.col("end")).alias("window_end"),
                     *feed.keys, *feed.sums)


def closed_windows(stream: DataFrame, feed: Feed, root: str) -> DataFrame:
    """The windows that ``run_counted`` has closed; of an alert feed those at or over the limit."""
    df = _named(_batches(stream.sparkSession, f"{root}/closed", _shape(stream, feed)), feed)
    return df if feed.least is None else df.where(F.col(feed.least[0]) >= feed.least[1])


def late_rows(stream: DataFrame, feed: Feed, root: str) -> DataFrame:
    """Rows that came too late, per window and key (null window: no event time)."""
    late = _batches(stream.sparkSession, f"{root}/late", _shape(stream, feed))
    return _named(late.groupBy("start", "end", *feed.keys).agg(*[F.sum(m).alias(m) for m in feed.sums]), feed)


def balance(stream: DataFrame, feed: Feed, root: str) -> DataFrame:
    """One row: rows in closed windows, rows late, rows in open windows. Their sum is the rows read."""
    spark, shape = stream.sparkSession, _shape(stream, feed)
    last = max(_batch_ids(spark, f"{root}/open"), default=None)
    open_now = (spark.createDataFrame([], shape) if last is None
                else spark.read.schema(shape).parquet(f"{root}/open/batch_id={last}").where("start is not null"))
    parts = {"closed": _batches(spark, f"{root}/closed", shape), "late": _batches(spark, f"{root}/late", shape), "open": open_now}
    sums = [df.agg(F.coalesce(F.sum(feed.rows), F.lit(0)).alias(n)) for n, df in parts.items()]
    return sums[0].select("closed", sums[1].scalar().alias("late"), sums[2].scalar().alias("open"))


def _windowed(stream: DataFrame, ts: str, width: str, keys: list[str], aggs: dict[str, Column],
              watermark: str) -> DataFrame:
    t = stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", watermark)
    return (t.groupBy(F.window("_et", width).alias("w"), *keys)
            .agg(*[c.alias(n) for n, c in aggs.items()])
            .select(wall_clock(F.col("w.start")).alias("window_start"),
                    wall_clock(F.col("w.end")).alias("window_end"), *keys, *aggs))


def live_orders(orders: DataFrame, width: str = "1 day", watermark: str = WATERMARK) -> DataFrame:
    """Orders and header revenue per status per window."""
    return _windowed(orders, "order_date", width, ["status"],
                     {"orders": F.count(F.lit(1)), "revenue": F.sum("total_amount")}, watermark)


def live_traffic(events: DataFrame, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Events and summed value per event type per window."""
    return _windowed(events, "ts", width, ["event_type"],
                     {"events": F.count(F.lit(1)), "value": F.sum("value")}, watermark)


def live_alerts(events: DataFrame, width: str = "1 hour", limit: int = 10, event_type: str = "error",
                watermark: str = WATERMARK) -> DataFrame:
    """T4: windows in which ``event_type`` events reach ``limit`` (append mode:
    each alert is emitted once, when its window closes)."""
    agg = _windowed(events.where(F.col("event_type") == event_type), "ts", width, ["event_type"],
                    {"events": F.count(F.lit(1))}, watermark)
    return agg.where(F.col("events") >= limit)


def run_daily(spark: SparkSession, store_root: str, out: str, checkpoint: str) -> None:
    """T2 over the ingest store, exact under backfill: every load counts.

    The windows that a micro-batch's orders fall into are computed anew from
    all loaded orders and replaced (dynamic partition overwrite by day), so a
    load of old orders corrects its days instead of being late. A retried
    batch replaces the same days with the same rows.
    """
    path = f"{store_root.rstrip('/')}/tables/orders"

    def replace(batch: DataFrame, _id: int) -> None:
        days = batch.select(F.to_date("order_date").alias("day")).distinct()
        rows = spark.read.schema(batch.schema).parquet(path).withColumn("day", F.to_date("order_date"))
        new = (rows.join(days, "day", "left_semi").groupBy("day", "status")
               .agg(F.count(F.lit(1)).alias("orders"), F.sum("total_amount").alias("revenue")))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)

    (loaded_orders_stream(spark, store_root).writeStream.foreachBatch(replace)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, delay: str = WATERMARK) -> DataFrame:
    """V8 for streams: drop repeats of a key seen within the watermark delay."""
    return (stream.withColumn("_et", event_time(F.col(ts))).withWatermark("_et", delay)
            .dropDuplicatesWithinWatermark(keys).drop("_et"))


def run_to_parquet(df: DataFrame, path: str, checkpoint: str) -> None:
    """Run a streaming frame to completion over the available input
    (availableNow), appending closed windows to a Parquet folder."""
    q = (df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
