"""Catalog: sources, ingest, load monitoring and datasets.

Each entry lands the driver tables as files under the shared checkpoint
folder, runs the load or materialisation, and reads the result back, so
the oracle compares loaded content with the source tables.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll import schemas as S
from tillroll.catalog.common import oracle, out
from tillroll.catalog.sales_entries import A1_SQL, A2_SQL, A3_SQL, A5_SQL
from tillroll.plans import datasets as DS
from tillroll.plans.metrics import latest_order_day
from tillroll.session import shared_dir
from tillroll.sources import ingest as I
from tillroll.sources import testdata as td

# Landing files hold this many rows each, so the number of files (and of
# write tasks) grows with the table; there are enough for every load batch.
ROWS_PER_LANDING_FILE = 50_000
# Load batches the multi-batch entries are split into.
BATCHES = 3
FILES_SQL = f"GREATEST({BATCHES}, CAST(CEIL(COUNT(*) / {ROWS_PER_LANDING_FILE}.0) AS BIGINT))"
AS_OF_SQL = "(SELECT MAX(CAST(order_date AS DATE)) FROM star_orders_plain)"


def landing_files(df: DataFrame) -> int:
    return max(BATCHES, math.ceil(df.count() / ROWS_PER_LANDING_FILE))


def land(df: DataFrame, path: str, fmt: str = "csv", files: int | None = None, by: str | None = None) -> str:
    """Write a frame as landing files of ~ROWS_PER_LANDING_FILE rows each
    (round-robin, so none is empty; with ``by`` the rows of a key share a file)."""
    files = files or landing_files(df)
    w = (df.repartition(files, by) if by else df.repartition(files)).write.mode("overwrite")
    if fmt in ("csv", "json"):
        w = w.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def ref_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Star orders in the reference landing layout."""
    o = td.orders(spark, sf)
    return o.select(F.col("order_id").cast("int"), F.col("customer_id").cast("string"), "order_date",
                    F.col("total_amount").cast("decimal(10,2)"), "status", "region")


REF_ORDERS_SQL = oracle("""SELECT order_id, CAST(customer_id AS VARCHAR) AS customer_id, order_date,
       CAST(total_amount AS DOUBLE) AS total_amount, status, region FROM star_orders""")

# The test-data item layout (line amount instead of unit price).
ITEMS_TD = T.StructType([
    T.StructField("order_id", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("line_number", T.IntegerType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("line_amount", T.DecimalType(12, 2)), T.StructField("discount", T.DecimalType(4, 2))])


def _ingest_orders(spark, sf):
    root = shared_dir(spark, "ingest")
    orders = ref_orders(spark, sf)
    files = landing_files(orders)
    src = land(orders, f"{root}/landing/orders", files=files)
    store = I.Store(f"{root}/store")
    per_batch = math.ceil(files / BATCHES)
    I.ingest(spark, "orders", src, store, max_files=per_batch)   # S4: files per batch
    I.ingest(spark, "orders", src, store)                 # S3: nothing new, loads 0 rows
    return store


def _s1(spark, sf):
    root = shared_dir(spark, "s1")
    src = land(ref_orders(spark, sf), f"{root}/landing/orders")
    return out(I.read_csv(spark, "orders", src))


def _s2(spark, sf):
    store = _ingest_orders(spark, sf)
    return out(I.loaded(spark, store, "orders").drop("batch_id"))


def _s3(spark, sf):
    """Load twice over the same files: the second run adds nothing."""
    store = _ingest_orders(spark, sf)
    loaded = I.loaded(spark, store, "orders")
    return loaded.agg(F.count(F.lit(1)).alias("rows_loaded"),
                      F.countDistinct("order_id").alias("distinct_orders"))


S3_SQL = oracle("SELECT COUNT(*) AS rows_loaded, COUNT(DISTINCT order_id) AS distinct_orders FROM star_orders")


def _s4(spark, sf):
    """Many landing files, at most ceil(files / 3) per batch: three load batches
    (fewer when there are fewer than three files)."""
    store = _ingest_orders(spark, sf)
    return (I.loaded(spark, store, "orders").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
            .agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("rows_loaded")))


S4_SQL = oracle(f"""SELECT CAST(CEIL(files / CEIL(files / {BATCHES}.0)) AS BIGINT) AS batches, rows_loaded
FROM (SELECT {FILES_SQL} AS files, CAST(COUNT(*) AS BIGINT) AS rows_loaded FROM star_orders) f""")


def _s5(spark, sf):
    root = shared_dir(spark, "s5")
    ev = td.events(spark, sf).select(F.col("event_id").cast("int").alias("id"), F.col("event_type").alias("name"),
                                     F.col("value").cast("decimal(10,2)").alias("value"),
                                     F.col("ts").alias("timestamp"))
    land(ev, f"{root}/landing/events")
    store = I.Store(f"{root}/store")
    I.ingest(spark, "data_import", f"{root}/landing", store, recursive=True)
    return out(I.loaded(spark, store, "data_import").drop("batch_id"))


S5_SQL = """SELECT CAST(event_id AS BIGINT) AS id, event_type AS name,
       CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS value, ts AS timestamp FROM events"""


def _s7(spark, sf):
    root = shared_dir(spark, "s7")
    items = td.order_items(spark, sf)
    # A zero discount arrives as a blank field; the column default restores it.
    blanked = items.withColumn("discount", F.when(F.col("discount") != 0, F.col("discount")))
    src = land(blanked, f"{root}/landing/order_items")
    store = I.Store(f"{root}/store")
    I.ingest(spark, "order_items", src, store, schema=ITEMS_TD)
    return out(I.loaded(spark, store, "order_items").drop("batch_id"))


S7_SQL = oracle("""SELECT order_id, product_id, CAST(line_number AS BIGINT) AS line_number,
       CAST(quantity AS BIGINT) AS quantity, CAST(line_amount AS DOUBLE) AS line_amount,
       CAST(discount AS DOUBLE) AS discount FROM star_items""")


def _ingest_with_empties(spark, sf):
    """The orders, a file of a header line alone and a file of no bytes, loaded in batches."""
    root = shared_dir(spark, "ingest-empties")
    orders = ref_orders(spark, sf)
    files = landing_files(orders)
    land(orders, f"{root}/landing/orders", files=files)
    land(orders.limit(0), f"{root}/landing/header_only", files=1)
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{root}/landing/nothing")
    store = I.Store(f"{root}/store")
    I.ingest(spark, "orders", f"{root}/landing/*/*.*", store, max_files=math.ceil(files / BATCHES))
    return store


def _s8(spark, sf):
    """Every landing file is in the history, those without rows too; LIMIT n keeps the newest n."""
    store = _ingest_with_empties(spark, sf)
    whole = I.load_history(spark, store, None, ["orders"])
    top = I.load_history(spark, store, 2, ["orders"]).agg(F.count(F.lit(1)).alias("n"))
    return (whole.groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("rows_loaded").alias("rows_loaded"),
                                        F.sum("rows_rejected").alias("rows_rejected"))
            .withColumn("listed_with_limit_2", top.scalar()))


EMPTIES_SQL = "(SELECT COUNT(*) FROM (SELECT 1 UNION ALL SELECT 2) e)"
S8_SQL = oracle(f"""SELECT 'loaded' AS status, {FILES_SQL} AS files, CAST(COUNT(*) AS BIGINT) AS rows_loaded,
       CAST(0 AS BIGINT) AS rows_rejected, CAST(2 AS BIGINT) AS listed_with_limit_2 FROM star_orders
UNION ALL SELECT 'empty', {EMPTIES_SQL}, 0, 0, 2""")


def _reject_store(spark, sf):
    """Line items landed in the reference item layout: quantities arrive as
    '23.0' and fail the INTEGER column, so every line is rejected."""
    root = shared_dir(spark, "s9")
    li = td.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("order_id"), F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("unit_price"),
        F.col("l_discount").alias("discount"))
    src = land(li, f"{root}/landing/order_items")
    store = I.Store(f"{root}/store")
    I.ingest(spark, "order_items", src, store)
    return store


def mixed_lines(spark, sf):
    """Line items as landing text: line 1 of an order has a quantity like 23.0,
    line 2 has n/a, the others fit."""
    return td.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.col("l_quantity").cast("int"), F.lit(".0")))
        .when(F.col("l_linenumber") == 2, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("unit_price"),
        F.col("l_discount").cast("decimal(3,2)").alias("discount"))


def _mixed_store(spark, sf):
    root = shared_dir(spark, "mixed")
    src = land(mixed_lines(spark, sf), f"{root}/landing/order_items")
    store = I.Store(f"{root}/store")
    I.ingest(spark, "order_items", src, store)
    return store


def _s1_rejects(spark, sf):
    """The rejected half of a batch scan."""
    src = land(mixed_lines(spark, sf), shared_dir(spark, "s1-rejects"))
    return I.scan(spark, "order_items", src).rejected.select("raw_line", F.array_join("reasons", ",").alias("reasons"))


LINE_SQL = """CAST(l_orderkey AS VARCHAR) || ',' || CAST(l_partkey AS VARCHAR) || ',' || {quantity} || ',' ||
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS VARCHAR) || ',' || CAST(CAST(l_discount AS DECIMAL(3,2)) AS VARCHAR)"""
S1R_SQL = f"""SELECT {LINE_SQL.format(quantity="CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0' ELSE 'n/a' END")} AS raw_line,
       'malformed_line,quantity_not_null' AS reasons FROM lineitem WHERE l_linenumber <= 2"""


def _s7_scan(spark, sf):
    """Batch scan: a blank discount is the default, a bad one rejects its line."""
    li = td.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("unit_price"),
        F.when(F.col("l_linenumber") == 1, "abc").when(F.col("l_linenumber") != 2, F.col("l_discount").cast("decimal(3,2)").cast("string")).alias("discount"))
    return out(I.read_csv(spark, "order_items", land(li, shared_dir(spark, "s7-scan"))))


S7S_SQL = """SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS unit_price,
       CASE l_linenumber WHEN 2 THEN 0.0::DOUBLE ELSE CAST(CAST(l_discount AS DECIMAL(3,2)) AS DOUBLE) END AS discount
FROM lineitem WHERE l_linenumber <> 1"""


def _retried(spark, sf):
    """Ingest, then retry twice with the same repair: quantities like 23.0 lose their fraction."""
    store = _mixed_store(spark, sf)
    mend = lambda line: F.regexp_replace(line, r"^([^,]*,[^,]*,[0-9]+)\.0,", "$1,")
    I.retry(spark, "order_items", store, repair=mend)
    I.retry(spark, "order_items", store, repair=mend)      # adds nothing
    return store


def _v7(spark, sf):
    """Rows that the retries have loaded."""
    return out(I.loaded(spark, _retried(spark, sf), "order_items").where("batch_id < 0").drop("batch_id"))


V7_SQL = """SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS unit_price,
       CAST(CAST(l_discount AS DECIMAL(3,2)) AS DOUBLE) AS discount FROM lineitem WHERE l_linenumber = 1"""


def _v7_open(spark, sf):
    """Rejects that stay open after the retries."""
    return I.open_rejects(spark, _retried(spark, sf), "order_items").select(
        "raw_line", F.array_join("reasons", ",").alias("reasons"))


V7O_SQL = f"""SELECT {LINE_SQL.format(quantity="'n/a'")} AS raw_line, 'malformed_line,quantity_not_null' AS reasons
FROM lineitem WHERE l_linenumber = 2"""


def _v8_latest(spark, sf):
    """Items land, then corrected items of every fifth order, up or down, in a newer file; one load takes both."""
    root = shared_dir(spark, "v8-latest")
    li = td.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("unit_price"), F.col("l_discount").cast("decimal(3,2)").alias("discount"))
    land(li, f"{root}/landing/1_first", by="order_id")
    fixed = li.where("order_id % 5 = 0").withColumn("quantity", F.when(F.col("order_id") % 10 == 0, F.col("quantity") * 2).otherwise(F.lit(0)))
    land(fixed, f"{root}/landing/2_fix", by="order_id")
    store = I.Store(f"{root}/store")
    I.ingest(spark, "order_items", f"{root}/landing/*", store)
    return out(I.current_rows(spark, store, "order_items"))


V8L_SQL = """SELECT l_orderkey AS order_id, CAST(l_partkey AS VARCHAR) AS product_id,
       CAST(CASE WHEN l_orderkey % 10 = 0 THEN l_quantity * 2 WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS unit_price,
       CAST(CAST(l_discount AS DECIMAL(3,2)) AS DOUBLE) AS discount FROM lineitem"""


def _s9_errors(spark, sf):
    store = _reject_store(spark, sf)
    return (I.load_errors(spark, store, 10, ["order_items"])
            .select("job_name", "raw_line", F.array_join("reasons", ",").alias("reasons"),
                    F.col("batch_id").cast("bigint")))


# The rejected lines as the CSV writer renders them (doubles in Java's
# shortest form, e.g. 23.0, 0.05), newest batch first, then by line text.
S9E_SQL = """SELECT 'order_items_import_job' AS job_name, raw_line,
       'malformed_line,quantity_not_null' AS reasons, CAST(0 AS BIGINT) AS batch_id
FROM (SELECT CAST(l_orderkey AS VARCHAR) || ',' || CAST(l_partkey AS VARCHAR) || ',' ||
             CAST(l_quantity AS VARCHAR) || ',' || CAST(l_extendedprice AS VARCHAR) || ',' ||
             CAST(l_discount AS VARCHAR) AS raw_line FROM lineitem) t
ORDER BY raw_line LIMIT 10"""


def _s9_reasons(spark, sf):
    store = _reject_store(spark, sf)
    rej = spark.read.parquet(store.rejects("order_items"))
    return rej.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


S9R_SQL = """SELECT 'malformed_line' AS reason, COUNT(*) AS rows FROM lineitem
UNION ALL SELECT 'quantity_not_null', COUNT(*) FROM lineitem"""


def _s10(spark, sf):
    """Three jobs of one store with three outcomes, and a table outside the pattern's reach."""
    store = _mixed_store(spark, sf)
    I.ingest(spark, "orders", land(ref_orders(spark, sf), f"{store.root}/landing/orders"), store)
    I.ingest(spark, "products", land(ref_orders(spark, sf).select("order_id"), f"{store.root}/landing/products"), store)
    I.ingest(spark, "data_import", f"{store.root}/landing/orders", store, job="orders_import_copy")
    return (I.load_jobs(spark, store, "%_import_job", ["orders", "order_items", "products", "data_import"])
            .drop("last_load_time"))


S10_SQL = oracle(f"""SELECT 'orders_import_job' AS job_name, 'orders' AS table_name,
       {FILES_SQL} AS files, CAST(COUNT(*) AS BIGINT) AS rows_loaded,
       CAST(0 AS BIGINT) AS rows_rejected, 'loaded' AS latest_status FROM star_orders
UNION ALL SELECT 'products_import_job', 'products', {FILES_SQL}, 0, COUNT(*), 'failed' FROM star_orders
UNION ALL SELECT 'order_items_import_job', 'order_items', {FILES_SQL},
       COUNT(*) FILTER (WHERE l_linenumber > 2), COUNT(*) FILTER (WHERE l_linenumber <= 2), 'partial' FROM lineitem""")


def _s11(spark, sf):
    """Per-file detail; file names and per-file row counts depend on the
    writer, so the compared columns are the per-file outcome."""
    store = _ingest_with_empties(spark, sf)
    return I.load_detail(spark, store, "orders_import_job", ["orders"]).select(
        "job_name", "table_name", "rows_rejected", "status", (F.col("rows_loaded") > 0).alias("has_rows"))


S11_SQL = oracle(f"""SELECT 'orders_import_job' AS job_name, 'orders' AS table_name, CAST(0 AS BIGINT) AS rows_rejected,
       'loaded' AS status, (SELECT COUNT(*) > 0 FROM star_orders) AS has_rows
FROM (SELECT UNNEST(range({FILES_SQL})) AS i FROM star_orders) f
UNION ALL SELECT 'orders_import_job', 'orders', 0, 'empty', FALSE FROM (SELECT UNNEST(range({EMPTIES_SQL}))) e""")


def _s6(spark, sf):
    store = _ingest_orders(spark, sf)
    db = f"analytics_{uuid.uuid4().hex[:8]}"
    I.create_tables(spark, db, store.root)
    I.create_tables(spark, db, store.root)          # idempotent
    I.refresh_partitions(spark, db)
    return I.table_counts(spark, db)


S6_SQL = oracle("""SELECT 'orders' AS table_name, COUNT(*) AS row_count FROM star_orders
UNION ALL SELECT 'order_items', 0 UNION ALL SELECT 'customers', 0 UNION ALL SELECT 'products', 0
UNION ALL SELECT 'data_import', 0""")


def _s18(fmt):
    def run(spark, sf):
        root = shared_dir(spark, f"s18-{fmt}")
        src = land(ref_orders(spark, sf), f"{root}/landing/orders", fmt)
        return out(I.read_any(spark, "orders", src, fmt))
    return run


def _star(spark, sf):
    return td.load_star(spark, sf)


def _dataset(name):
    def run(spark, sf):
        loc = shared_dir(spark, "datasets")
        DS.create_dataset(spark, name, _star(spark, sf), loc)
        return out(DS.read_dataset(spark, name, loc))
    return run


def _s14(spark, sf):
    loc = shared_dir(spark, "datasets")
    return DS.refresh_datasets(spark, _star(spark, sf), loc)


S14_SQL = oracle("""
SELECT 'sales_by_region' AS dataset, 'ok' AS status,
       (SELECT COUNT(DISTINCT region) FROM star_orders WHERE status = 'completed') AS rows, CAST(NULL AS VARCHAR) AS error
UNION ALL SELECT 'top_products', 'ok', (SELECT LEAST(10, COUNT(*)) FROM (SELECT DISTINCT product_name, category
  FROM star_ps WHERE status = 'completed') t), NULL
UNION ALL SELECT 'customer_segments', 'ok', (SELECT COUNT(DISTINCT customer_segment) FROM star_customers), NULL
UNION ALL SELECT 'daily_sales', 'ok', (SELECT COUNT(DISTINCT CAST(order_date AS DATE)) FROM star_orders WHERE status = 'completed'), NULL
UNION ALL SELECT 'category_performance', 'ok', (SELECT COUNT(DISTINCT category) FROM star_ps WHERE status = 'completed'), NULL
UNION ALL SELECT 'orders_with_customers', 'ok', (SELECT COUNT(*) FROM star_orders), NULL
UNION ALL SELECT 'product_sales', 'ok', (SELECT COUNT(*) FROM star_ps), NULL
UNION ALL SELECT 'daily_rollup', 'ok', (SELECT COUNT(*) FROM (SELECT DISTINCT CAST(order_date AS DATE), region, category
  FROM star_ps WHERE status = 'completed') t), NULL
UNION ALL SELECT 'order_sets', 'ok', (SELECT COUNT(*) FROM (SELECT DISTINCT day, region, cats FROM (
  SELECT order_id, CAST(order_date AS DATE) AS day, region, list_sort(list(DISTINCT category)) AS cats
  FROM star_ps WHERE status = 'completed' GROUP BY 1, 2, 3) s) t), NULL""", """star_ps AS (
  SELECT oi.*, p.category, p.product_name, o.order_date, o.status, o.region
  FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
  JOIN star_orders o ON oi.order_id = o.order_id)""")


def _s15(spark, sf):
    """Daily sales published, then a star in which one month has lost all its
    orders and later amounts have changed; only the months from there on are rebuilt."""
    loc = shared_dir(spark, "datasets")
    star = _star(spark, sf)
    DS.create_dataset(spark, "daily_sales", star, loc)
    gone = F.trunc(F.date_sub(latest_order_day(star.orders), 60), "month")   # scalar subquery, stays in the plan
    o = star.orders.where(F.trunc("order_date", "month") != gone)
    o = o.withColumn("total_amount", F.when(F.to_date("order_date") >= gone, F.col("total_amount") + 1)
                     .otherwise(F.col("total_amount")).cast("decimal(12,2)"))
    changed = td.Star(orders=o, order_items=star.order_items, customers=star.customers, products=star.products)
    DS.refresh_incremental(spark, "daily_sales", changed, loc, F.date_sub(latest_order_day(star.orders), 60))
    return out(DS.read_dataset(spark, "daily_sales", loc))


GONE_SQL = f"date_trunc('month', {AS_OF_SQL} - INTERVAL 60 DAY)"
S15_SQL = oracle(f"""SELECT CAST(order_date AS DATE) AS order_date, COUNT(DISTINCT order_id) AS orders,
       CAST(SUM(total_amount + CASE WHEN CAST(order_date AS DATE) >= {GONE_SQL} THEN 1 ELSE 0 END) AS DOUBLE) AS revenue
FROM star_orders_plain WHERE status = 'completed' AND date_trunc('month', order_date) <> {GONE_SQL}
GROUP BY CAST(order_date AS DATE)""")


def _s16(spark, sf):
    """A published dataset after retention: older months are gone from storage."""
    loc = shared_dir(spark, "datasets")
    star = _star(spark, sf)
    DS.create_dataset(spark, "daily_sales", star, loc)
    DS.retain_dataset(spark, "daily_sales", loc, latest_order_day(star.orders), 365)
    return out(DS.read_dataset(spark, "daily_sales", loc))


S16_SQL = oracle(f"""SELECT * FROM (
SELECT CAST(order_date AS DATE) AS order_date, COUNT(DISTINCT order_id) AS orders,
       CAST(SUM(total_amount) AS DOUBLE) AS revenue
FROM star_orders_plain WHERE status = 'completed'
GROUP BY CAST(order_date AS DATE)) d
WHERE order_date > {AS_OF_SQL} - INTERVAL 365 DAY AND order_date <= {AS_OF_SQL}""")


def _s17(spark, sf):
    return out(DS.dataset_view(spark, "sales_by_region", _star(spark, sf)))


def _s19(spark, sf):
    df = DS.build("customer_segments", _star(spark, sf))
    expected = [c for c, _t in S.DATASET_SCHEMAS["customer_segments"]]
    assert df.columns == expected, df.columns
    return out(df)


def _s20(spark, sf):
    return out(DS.daily_rollup(_star(spark, sf)))


S20_SQL = oracle("""
SELECT CAST(o.order_date AS DATE) AS order_date, o.region, p.category,
       CAST(SUM(oi.line_amount * (1 - oi.discount)) AS DOUBLE) AS revenue,
       CAST(SUM(oi.quantity * p.unit_cost) AS DOUBLE) AS cost, CAST(SUM(oi.quantity) AS BIGINT) AS units_sold,
       COUNT(*) AS lines, COUNT(DISTINCT oi.order_id) AS orders
FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
JOIN star_orders o ON oi.order_id = o.order_id
WHERE o.status = 'completed' GROUP BY 1, 2, 3""")


def _s20_category(spark, sf):
    loc = shared_dir(spark, "datasets")
    DS.create_dataset(spark, "daily_rollup", _star(spark, sf), loc)
    return out(DS.category_from_rollup(DS.read_dataset(spark, "daily_rollup", loc)))


CHOICE = ["PROMO", "SMALL"]


def _s20_orders(spark, sf):
    """Distinct orders per region over all categories and over a choice of them, from the published sets."""
    loc = shared_dir(spark, "datasets")
    DS.create_dataset(spark, "order_sets", _star(spark, sf), loc)
    sets = DS.read_dataset(spark, "order_sets", loc)
    every = DS.orders_from_sets(sets, ["region"]).withColumn("categories", F.lit("all"))
    some = DS.orders_from_sets(sets, ["region"], CHOICE).withColumn("categories", F.lit("some"))
    return every.unionByName(some)


S20O_SQL = oracle(f"""
SELECT region, COUNT(DISTINCT order_id) AS orders, 'all' AS categories FROM lines GROUP BY region
UNION ALL SELECT region, COUNT(DISTINCT order_id), 'some' FROM lines WHERE category IN {tuple(CHOICE)} GROUP BY region""",
                  """lines AS (SELECT o.region, o.order_id, p.category FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
  JOIN star_orders o ON oi.order_id = o.order_id WHERE o.status = 'completed')""")

ENTRIES = {
    "s1_csv_scan": (_s1, REF_ORDERS_SQL),
    "s1_scan_rejects": (_s1_rejects, S1R_SQL),
    "s7_scan_default": (_s7_scan, S7S_SQL),
    "v7_retry_rejects": (_v7, V7_SQL),
    "v7_open_rejects": (_v7_open, V7O_SQL),
    "v8_latest_load_wins": (_v8_latest, V8L_SQL),
    "s20_orders_from_sets": (_s20_orders, S20O_SQL),
    "s2_ingest_orders": (_s2, REF_ORDERS_SQL),
    "s3_load_each_file_once": (_s3, S3_SQL),
    "s4_batch_files_per_load": (_s4, S4_SQL),
    "s5_catch_all_loader": (_s5, S5_SQL),
    "s6_create_tables": (_s6, S6_SQL),
    "s7_column_default": (_s7, S7_SQL),
    "s8_load_history": (_s8, S8_SQL),
    "s9_load_errors": (_s9_errors, S9E_SQL),
    "s9_reject_reasons": (_s9_reasons, S9R_SQL),
    "s10_load_jobs": (_s10, S10_SQL),
    "s11_load_detail": (_s11, S11_SQL),
    "s12_create_dataset": (_dataset("category_performance"), A5_SQL),
    "s13_create_single_dataset": (_dataset("top_products"), A2_SQL),
    "s14_refresh_datasets": (_s14, S14_SQL),
    "s15_refresh_incremental": (_s15, S15_SQL),
    "s16_retention": (_s16, S16_SQL),
    "s17_dataset_view": (_s17, A1_SQL),
    "s18_json_source": (_s18("json"), REF_ORDERS_SQL),
    "s18_parquet_source": (_s18("parquet"), REF_ORDERS_SQL),
    "s19_dataset_schema": (_s19, A3_SQL),
    "s20_daily_rollup": (_s20, S20_SQL),
    "s20_category_from_rollup": (_s20_category, A5_SQL),
}
