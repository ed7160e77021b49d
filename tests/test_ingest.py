"""Ingest: load-once, new files, malformed rows, defaults, idempotent
batches, monitoring listings, catalog tables, datasets."""

import os

from pyspark.sql import functions as F

from tests.sample import CUSTOMERS, ORDER_ITEMS, ORDERS, csv_text
from tillroll import schemas as S
from tillroll.operators import quality
from tillroll.plans import datasets as DS
from tillroll.session import local_path, shared_dir
from tillroll.sources import ingest as I
from tillroll.sources import testdata as td
from tests.conftest import SF001

ORDERS_HEADER = "order_id,customer_id,order_date,total_amount,status,region"
ITEMS_HEADER = "order_id,product_id,quantity,unit_price,discount"


def write(path, name, text):
    p = local_path(path)
    os.makedirs(p, exist_ok=True)
    with open(f"{p}/{name}", "w") as f:
        f.write(text)


def test_ingest_loads_each_file_once(spark):
    root = shared_dir(spark, "test-ingest")
    land, store = f"{root}/landing/orders", I.Store(f"{root}/store")
    write(land, "a.csv", csv_text(ORDERS_HEADER, ORDERS[:6]))
    I.ingest(spark, "orders", land, store)
    assert I.loaded(spark, store, "orders").count() == 6
    I.ingest(spark, "orders", land, store)                    # nothing new
    assert I.loaded(spark, store, "orders").count() == 6
    write(land, "b.csv", csv_text(ORDERS_HEADER, ORDERS[6:]))  # a new file adds only its rows
    I.ingest(spark, "orders", land, store)
    got = I.loaded(spark, store, "orders")
    assert got.count() == 10 and got.select("order_id").distinct().count() == 10
    assert dict(got.groupBy("batch_id").count().collect()) == {0: 6, 1: 4}


def test_malformed_and_overlong_rows_are_rejected(spark):
    root = shared_dir(spark, "test-rejects")
    land, store = f"{root}/landing/orders", I.Store(f"{root}/store")
    bad = [(2001, "C001", "2024-01-15 10:23:00", "12x.50", "completed", "us-east"),
           (2002, "C0000000001", "2024-01-15 10:23:00", "10.00", "completed", "us-east"),
           (2003, "C001", "2024-01-15 10:23:00", "10.00", "completed", None)]
    write(land, "a.csv", csv_text(ORDERS_HEADER, ORDERS[:2] + [tuple("" if v is None else v for v in r) for r in bad]))
    I.ingest(spark, "orders", land, store)
    assert I.loaded(spark, store, "orders").count() == 2
    errs = {r["raw_line"].split(",")[0]: set(r["reasons"]) for r in I.load_errors(spark, store, 10, ["orders"]).collect()}
    assert errs["2001"] >= {"malformed_line"}
    assert errs["2002"] == {"customer_id_max_length_10"}
    assert errs["2003"] == {"region_not_null"}
    hist = I.load_history(spark, store, 10, ["orders"]).collect()
    assert [(h["rows_loaded"], h["rows_rejected"], h["status"]) for h in hist] == [(2, 3, "partial")]
    jobs = I.load_jobs(spark, store, "%_import_job", ["orders"]).collect()
    assert jobs[0]["job_name"] == "orders_import_job" and jobs[0]["latest_status"] == "partial"
    assert I.load_detail(spark, store, "orders_import_job", ["orders"]).count() == 1


def test_blank_discount_takes_default(spark):
    root = shared_dir(spark, "test-default")
    land, store = f"{root}/landing/order_items", I.Store(f"{root}/store")
    rows = [r[:4] + ("",) for r in ORDER_ITEMS[:3]] + list(ORDER_ITEMS[3:5])
    write(land, "a.csv", csv_text(ITEMS_HEADER, rows))
    I.ingest(spark, "order_items", land, store)
    got = {(r["order_id"], r["product_id"]): str(r["discount"]) for r in I.loaded(spark, store, "order_items").collect()}
    assert got[(1001, "P101")] == "0.00" and got[(1003, "P101")] == "0.15"


def test_batch_rerun_overwrites_its_partition(spark):
    """foreachBatch is at-least-once: running a batch again replaces its output."""
    root = shared_dir(spark, "test-rerun")
    land, store = f"{root}/landing/orders", I.Store(f"{root}/store")
    write(land, "a.csv", csv_text(ORDERS_HEADER, ORDERS[:4] + [(1, "C001", "", "", "completed", "us-east")]))
    listing = spark.read.format("binaryFile").load(land).select(
        "path", F.col("_metadata.file_path").alias("file_path"), F.col("modificationTime").alias("file_modification_time"), "length")
    fn = I._batch_writer("orders", S.ORDERS, store, "orders_import_job", "csv", I.table_rules("orders", S.ORDERS))
    fn(listing, 7)
    fn(listing, 7)
    assert I.loaded(spark, store, "orders").count() == 4
    assert spark.read.parquet(store.rejects("orders")).count() == 1
    assert spark.read.parquet(store.audit("orders")).count() == 1


def test_retry_rejects_parses_fixed_lines(spark):
    rej = spark.createDataFrame([("1001,C001,2024-01-15 10:23:00,1250.50,completed,us-east",),
                                 ("1002,C002,2024-01-15 11:45:00,12x,completed,us-west",)], "raw_line string")
    good, still = quality.retry_rejects(rej, S.ORDERS)
    assert [r["order_id"] for r in good.collect()] == [1001]
    assert still.count() == 1


def test_read_any_formats(spark):
    root = shared_dir(spark, "test-formats")
    o = td.orders_plain(spark, SF001).select(F.col("order_id").cast("int"), F.col("customer_id").cast("string"),
                                             "order_date", F.col("total_amount").cast("decimal(10,2)"), "status",
                                             F.lit("x").alias("region"))
    for fmt in ("json", "parquet", "csv"):
        w = o.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        w.save(f"{root}/{fmt}")
        assert I.read_any(spark, "orders", f"{root}/{fmt}", fmt).count() == o.count()


def test_create_tables_is_idempotent(spark):
    root = shared_dir(spark, "test-ddl")
    made = I.create_tables(spark, "analytics_test_ddl", root)
    assert I.create_tables(spark, "analytics_test_ddl", root) == made
    cols = [c.name for c in spark.catalog.listColumns("analytics_test_ddl.orders")]
    assert cols[:6] == [f.name for f in S.ORDERS.fields]


def test_refresh_continues_after_failure(spark):
    star = td.load_star(spark, SF001)
    loc = shared_dir(spark, "test-datasets")
    broken = DS.Dataset("broken", lambda s: s.orders.select("no_such_column"))
    DS.REGISTRY["broken"] = broken
    try:
        res = {r["dataset"]: r for r in DS.refresh_datasets(spark, star, loc, ["sales_by_region", "broken", "daily_sales"]).collect()}
    finally:
        del DS.REGISTRY["broken"]
    assert res["broken"]["status"] == "failed"
    assert res["sales_by_region"]["status"] == "ok" and res["daily_sales"]["status"] == "ok"


def test_incremental_refresh_equals_full(spark):
    star = td.load_star(spark, SF001)
    loc = shared_dir(spark, "test-incr")
    DS.create_dataset(spark, "daily_sales", star, loc)
    DS.refresh_incremental(spark, "daily_sales", star, loc, "2001-01-15")
    got = sorted(map(tuple, DS.read_dataset(spark, "daily_sales", loc).collect()))
    want = sorted(map(tuple, DS.build("daily_sales", star).collect()))
    assert got == want


CUSTOMERS_HEADER = "customer_id,name,email,signup_date,customer_segment,country"
PRODUCTS_HEADER = "product_id,product_name,category,subcategory,unit_cost,supplier_id"


def test_end_to_end_sample_load_and_publish(spark):
    """The reference demo: four CSV files land, are loaded, and the published
    datasets give the sample results; a corrected row in a new file wins."""
    from tests.sample import PRODUCTS
    from tillroll.plans import sales
    root = shared_dir(spark, "test-e2e")
    land, store = f"{root}/landing", I.Store(f"{root}/store")
    write(f"{land}/orders", "orders.csv", csv_text(ORDERS_HEADER, ORDERS))
    write(f"{land}/order_items", "order_items.csv", csv_text(ITEMS_HEADER, ORDER_ITEMS))
    write(f"{land}/customers", "customers.csv", csv_text(CUSTOMERS_HEADER, CUSTOMERS))
    write(f"{land}/products", "products.csv", csv_text(PRODUCTS_HEADER, PRODUCTS))
    for t in ("orders", "order_items", "customers", "products"):
        I.ingest(spark, t, f"{land}/{t}", store)
    star = I.star_from_store(spark, store)
    counts = {t: getattr(star, t).count() for t in ("orders", "order_items", "customers", "products")}
    assert counts == {"orders": 10, "order_items": 16, "customers": 7, "products": 8}
    first = sales.sales_by_region(star.orders).first()
    assert (first["region"], first["total_orders"], str(first["total_revenue"])) == ("us-east", 3, "5018.80")
    # a corrected order 1004 arrives in a new file: the latest load wins
    write(f"{land}/orders", "orders_fix.csv",
          csv_text(ORDERS_HEADER, [(1004, "C001", "2024-01-16 09:15:00", "600.00", "completed", "us-east")]))
    I.ingest(spark, "orders", f"{land}/orders", store)
    star = I.star_from_store(spark, store)
    assert star.orders.count() == 10
    first = sales.sales_by_region(star.orders).first()
    assert str(first["total_revenue"]) == "5051.00"
    loc = shared_dir(spark, "test-e2e-out")
    res = {r["dataset"]: r["rows"] for r in DS.refresh_datasets(spark, star, loc).collect()}
    assert res["sales_by_region"] == 4 and res["top_products"] == 7 and res["customer_segments"] == 3


def test_failed_rebuild_keeps_the_published_copy(spark):
    star = td.load_star(spark, SF001)
    loc = shared_dir(spark, "test-slots")
    DS.create_dataset(spark, "sales_by_region", star, loc)
    before = sorted(map(tuple, DS.read_dataset(spark, "sales_by_region", loc).collect()))
    good = DS.REGISTRY["sales_by_region"]
    DS.REGISTRY["sales_by_region"] = DS.Dataset(
        "sales_by_region", lambda s: good.build(s).withColumn("total_orders", F.raise_error(F.lit("boom"))))
    try:
        res = DS.refresh_datasets(spark, star, loc, ["sales_by_region"]).first()
    finally:
        DS.REGISTRY["sales_by_region"] = good
    assert res["status"] == "failed"
    assert sorted(map(tuple, DS.read_dataset(spark, "sales_by_region", loc).collect())) == before
    DS.create_dataset(spark, "sales_by_region", star, loc)            # next good build flips the slot
    assert sorted(map(tuple, DS.read_dataset(spark, "sales_by_region", loc).collect())) == before


def test_missing_column_and_empty_file(spark):
    root = shared_dir(spark, "test-short-rows")
    land, store = f"{root}/landing/orders", I.Store(f"{root}/store")
    write(land, "a.csv", ORDERS_HEADER + "\n1001,C001,2024-01-15 10:23:00,1250.50,completed\n"
          + "1002,C002,2024-01-15 11:45:00,890.25,completed,us-west\n")
    write(land, "b.csv", ORDERS_HEADER + "\n")          # header only
    write(land, "c.csv", "")                             # empty file
    I.ingest(spark, "orders", land, store)
    assert [r["order_id"] for r in I.loaded(spark, store, "orders").collect()] == [1002]
    errs = I.load_errors(spark, store, 10, ["orders"]).collect()
    assert len(errs) == 1 and "region_not_null" in errs[0]["reasons"]
    # files without rows are in the history and in the detail
    hist = {r["file_path"].rsplit("/", 1)[1]: (r["rows_loaded"], r["rows_rejected"], r["status"])
            for r in I.load_history(spark, store, 10, ["orders"]).collect()}
    assert hist == {"a.csv": (1, 1, "partial"), "b.csv": (0, 0, "empty"), "c.csv": (0, 0, "empty")}
    assert I.load_detail(spark, store, "orders_import_job", ["orders"]).count() == 3
    job = I.load_jobs(spark, store, "%_import_job", ["orders"]).first()
    assert (job["files"], job["latest_status"]) == (3, "partial")  # the worst of the newest batch


def test_only_empty_files(spark):
    root = shared_dir(spark, "test-empty-files")
    land, store = f"{root}/landing/orders", I.Store(f"{root}/store")
    write(land, "c.csv", "")
    I.ingest(spark, "orders", land, store)
    assert I.loaded(spark, store, "orders").count() == 0
    assert [r["status"] for r in I.load_history(spark, store, 10, ["orders"]).collect()] == ["empty"]


def test_bad_field_is_a_reject_in_the_batch_scan_too(spark):
    """A discount of abc is no 0.00, whatever columns a query selects; good rows keep defaults."""
    root = shared_dir(spark, "test-scan")
    land = f"{root}/landing/order_items"
    write(land, "a.csv", ITEMS_HEADER + "\n1,P1,2,3.00,abc\n1,P2,2,3.00,\n2,P1,x,3.00,0.10\n2,P2,1,3.00,0.10,9\n2,P3,1,3.00\n,P4,1,3.00,0.10\n")
    got = I.scan(spark, "order_items", land)
    reasons = {r["raw_line"]: r["reasons"] for r in got.rejected.collect()}
    assert set(reasons) == {"1,P1,2,3.00,abc", "2,P1,x,3.00,0.10", "2,P2,1,3.00,0.10,9", "2,P3,1,3.00", ",P4,1,3.00,0.10"}
    assert reasons["1,P1,2,3.00,abc"] == ["malformed_line"] and reasons[",P4,1,3.00,0.10"] == ["order_id_not_null"]
    read = I.read_csv(spark, "order_items", land)
    assert [(r["order_id"], r["product_id"], str(r["discount"])) for r in read.collect()] == [(1, "P2", "0.00")]
    assert [r["order_id"] for r in read.select("order_id").collect()] == [1] and read.count() == 1
    assert got.rejected.count() == 5


def test_malformed_json_and_parquet_rules(spark):
    root = shared_dir(spark, "test-scan-json")
    write(f"{root}/j", "a.json", '{"order_id": 1, "product_id": "P1", "quantity": 2, "unit_price": 3.00}\n{"order_id": "x", "product_id": "P1", "quantity": 2, "unit_price": 3.00}\n{broken\n')
    got = I.scan(spark, "order_items", f"{root}/j", "json")
    assert [(r["order_id"], str(r["discount"])) for r in got.good.collect()] == [(1, "0.00")]
    assert got.rejected.count() == 2
    spark.createDataFrame([(1, "P1", 1, None, None), (2, "P2", 1, None, None)], S.ORDER_ITEMS).write.parquet(f"{root}/p")
    got = I.scan(spark, "order_items", f"{root}/p", "parquet")
    assert got.good.count() == 0 and {tuple(r["reasons"]) for r in got.rejected.collect()} == {("unit_price_not_null",)}


def test_quoted_newlines_with_multi_line(spark):
    root = shared_dir(spark, "test-multiline")
    land, store = f"{root}/landing/customers", I.Store(f"{root}/store")
    write(land, "a [x].csv", CUSTOMERS_HEADER + '\nC1,"Ann\nLee",a@b.c,2024-01-01,Premium,US\nC2,Bo,b@b.c,2024-01-01,Basic,US\n')
    I.ingest(spark, "customers", land, store, multi_line=True)
    assert {r["customer_id"]: r["name"] for r in I.loaded(spark, store, "customers").collect()} == {"C1": "Ann\nLee", "C2": "Bo"}
    hist = I.load_history(spark, store, 10, ["customers"]).collect()   # a name with blanks and brackets is one file
    assert [(r["rows_loaded"], r["status"]) for r in hist] == [(2, "loaded")]


def test_retry_life_cycle(spark):
    """Rejects are retried end to end: mended lines load once, under a batch of their own; the rest stays open."""
    root = shared_dir(spark, "test-retry")
    land, store = f"{root}/landing/order_items", I.Store(f"{root}/store")
    write(land, "a.csv", ITEMS_HEADER + "\n1,P1,2.0,3.00,0.10\n1,P1,2.0,3.00,0.10\n1,P2,1,3.00,\n2,P1,n/a,3.00,0.10\n")
    I.ingest(spark, "order_items", land, store)
    assert I.loaded(spark, store, "order_items").count() == 1
    mend = lambda line: F.regexp_replace(line, r"^([^,]*,[^,]*,[0-9]+)\.0,", "$1,")
    assert I.retry(spark, "order_items", store) == 0                     # nothing has changed
    assert I.retry(spark, "order_items", store, repair=mend) == 2        # equal lines are two rejects
    got = I.loaded(spark, store, "order_items")
    assert sorted((r["order_id"], r["product_id"], r["quantity"], r["batch_id"]) for r in got.collect()) == [
        (1, "P1", 2, -1), (1, "P1", 2, -1), (1, "P2", 1, 0)]
    assert I.retry(spark, "order_items", store, repair=mend) == 0 and I.loaded(spark, store, "order_items").count() == 3
    assert [r["raw_line"] for r in I.load_errors(spark, store, 10, ["order_items"]).collect()] == ["2,P1,n/a,3.00,0.10"]
    assert I.retry(spark, "order_items", store, repair=lambda c: F.regexp_replace(c, "n/a", "7")) == 1
    assert dict(I.loaded(spark, store, "order_items").groupBy("batch_id").count().collect()) == {0: 1, -1: 2, -2: 1}
    assert I.load_errors(spark, store, 10, ["order_items"]).count() == 0
    jobs = {r["job_name"]: (r["rows_loaded"], r["rows_rejected"], r["latest_status"])
            for r in I.load_jobs(spark, store, "%_job", ["order_items"]).collect()}
    assert jobs == {"order_items_import_job": (1, 3, "partial"), "order_items_retry_job": (3, 1, "loaded")}


def test_retry_that_died_is_repeated_without_copies(spark):
    """Good rows written, keys not committed: the next run replaces them."""
    from tillroll.session import path_exists
    root = shared_dir(spark, "test-retry-died")
    land, store = f"{root}/landing/order_items", I.Store(f"{root}/store")
    write(land, "a.csv", ITEMS_HEADER + "\n1,P1,2.0,3.00,0.10\n2,P1,3.0,3.00,0.10\n")
    I.ingest(spark, "order_items", land, store)
    mend = lambda line: F.regexp_replace(line, r"\.0,", ",")
    resolved = store.resolved
    store.resolved = lambda t: "nowhere://" + resolved(t) if path_exists(spark, f"{store.table(t)}/batch_id=-1") else resolved(t)
    try:
        I.retry(spark, "order_items", store, repair=mend)
        raise AssertionError("the commit should have failed")
    except Exception as e:
        assert "nowhere" in str(e)
    del store.resolved
    assert I.loaded(spark, store, "order_items").count() == 2 and I.open_rejects(spark, store, "order_items").count() == 2
    assert I.retry(spark, "order_items", store, repair=mend) == 2
    assert I.loaded(spark, store, "order_items").count() == 2 and I.open_rejects(spark, store, "order_items").count() == 0


def test_latest_load_wins(spark):
    """Corrections up and down, in one batch and in later ones; two lines of one file stay; a retried
    reject counts as its own file's row."""
    import time
    root = shared_dir(spark, "test-latest")
    land, store = f"{root}/landing/order_items", I.Store(f"{root}/store")
    first = "1,P1,5,3.00,0.10\n1,P2,5,3.00,0.10\n2,P1,9,3.00,0.10\n3,P1,1,1.00,0.00\n4,P1,4.0,1.00,0.00\n"
    write(land, "b.csv", ITEMS_HEADER + "\n" + first)
    time.sleep(0.05)
    write(land, "a.csv", ITEMS_HEADER + "\n1,P1,2,3.00,0.10\n1,P1,2,3.00,0.10\n1,P1,1,3.00,0.50\n2,P1,99,3.00,0.10\n4,P1,7,1.00,0.00\n")
    I.ingest(spark, "order_items", land, store)                     # one batch, the newer file has the smaller name
    write(f"{root}/landing/orders", "o.csv", csv_text(ORDERS_HEADER, ORDERS))
    write(f"{root}/landing/customers", "c.csv", CUSTOMERS_HEADER + "\n")
    write(f"{root}/landing/products", "p.csv", PRODUCTS_HEADER + "\n")
    for t in ("orders", "customers", "products"):
        I.ingest(spark, t, f"{root}/landing/{t}", store)
    rows = lambda: sorted((r["order_id"], r["product_id"], r["quantity"]) for r in I.star_from_store(spark, store).order_items.collect())
    want = [(1, "P1", 1), (1, "P1", 2), (1, "P1", 2), (1, "P2", 5), (2, "P1", 99), (3, "P1", 1), (4, "P1", 7)]
    assert rows() == want
    assert I.retry(spark, "order_items", store, repair=lambda c: F.regexp_replace(c, r"\.0,", ",")) == 1
    assert rows() == want                                            # order 4 of the old file loses to the new file
    time.sleep(0.05)
    write(land, "c.csv", ITEMS_HEADER + "\n2,P1,1,3.00,0.10\n")
    I.ingest(spark, "order_items", land, store)
    assert rows() == [w if w[0] != 2 else (2, "P1", 1) for w in want]


def test_latest_version_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (None, 2, "c"), (7, 1, "d"), (7, None, "e")], "k int, v int, x string")
    got = quality.latest_version(df, ["k"], ["v"]).collect()
    assert sorted(r["x"] for r in got) == ["b", "c", "d"]


def test_timed_load_registers_partitions(spark):
    """A load with a timed trigger keeps picking up files; its rows are in the catalog table without another call."""
    import time
    import uuid
    root = shared_dir(spark, "test-continuous")
    land, store, db = f"{root}/landing/orders", I.Store(f"{root}/store"), f"live_{uuid.uuid4().hex[:8]}"
    I.create_tables(spark, db, store.root)
    write(land, "a.csv", csv_text(ORDERS_HEADER, ORDERS[:6]))
    q = I.ingest(spark, "orders", land, store, every="1 second", db=db)

    def reaches(n):
        for _ in range(120):
            if spark.table(f"{db}.orders").count() == n:
                return True
            assert q.isActive, q.exception()
            time.sleep(0.5)
        return False
    try:
        assert reaches(6)
        write(land, "b.csv", csv_text(ORDERS_HEADER, ORDERS[6:]))
        assert reaches(10)
    finally:
        q.stop()


def test_retry_parses_a_line_once_and_only_open_ones(spark, capfd):
    """A reject's line is parsed by one expression, above the join that drops the settled rejects."""
    root = shared_dir(spark, "test-retry-plan")
    land, store = f"{root}/landing/order_items", I.Store(f"{root}/store")
    write(land, "a.csv", f"{ITEMS_HEADER}\n1,P1,2.0,10.00,0.10\n2,P2,n/a,10.00,0.10\n3,P3,1,10.00,0.10\n")
    I.ingest(spark, "order_items", land, store)
    parsed, mend = [], lambda line: F.regexp_replace(line, r"\.0,", ",")
    real = I.parse
    try:
        I.parse = lambda *a, **k: parsed.append(real(*a, **k)) or parsed[-1]
        assert I.retry(spark, "order_items", store, repair=mend) == 1
        assert I.retry(spark, "order_items", store, repair=mend) == 0
    finally:
        I.parse = real
    for p in parsed:
        capfd.readouterr()
        p.good.explain()
        plan = capfd.readouterr().out
        assert plan.count("from_csv(") == 1
    assert plan.index("from_csv(") < plan.index("LeftAnti")
    assert [r["raw_line"] for r in I.open_rejects(spark, store, "order_items").collect()] == ["2,P2,n/a,10.00,0.10"]


def test_one_spelling_of_file_paths(spark):
    paths = ["file:/a/b", "file:///a/b", "file:////a/b", "file://a", "s3://x/file:/y", "/a", None]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert ([r[0] for r in rows.select(I.file_name(F.col("p"))).collect()]
            == [r[0] for r in rows.select(F.regexp_replace("p", "^file:/+", "file:///")).collect()])


def test_clean_files_are_read_once(spark):
    """A load without rejected rows makes one pass over its files, one with a rejected row makes two."""
    root, calls = shared_dir(spark, "test-passes"), spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def rule(order_id):
        calls.add(1)
        return order_id != 1009

    passes = {}
    for name, rows in (("clean", ORDERS[:4]), ("mixed", ORDERS)):
        write(f"{root}/{name}", "a.csv", csv_text(ORDERS_HEADER, rows))
        store, before = I.Store(f"{root}/store-{name}"), calls.value
        I.ingest(spark, "orders", f"{root}/{name}", store, rules={"odd": rule("order_id")})
        passes[name] = (calls.value - before) / len(rows)
        assert I.loaded(spark, store, "orders").count() == len([r for r in rows if r[0] != 1009])
        rejects = spark.read.parquet(store.rejects("orders"))
        assert rejects.count() == len([r for r in rows if r[0] == 1009])
        assert set(I.REJECT_DDL.replace(" ", ",").split(",")) >= set(rejects.columns)
    assert passes["clean"] == 1 and passes["mixed"] >= 2


def test_latest_version_is_joined_by_its_keys(spark, capfd):
    """The version is no join key, and keys of every kind compare null to null."""
    import datetime as dt
    day = dt.date(1970, 1, 1)
    df = spark.createDataFrame(
        [(None, "", day, True, 1, "b", "a"), (None, "", day, True, 1, "c", "b"), (0, "", day, True, 1, "a", "c"),
         (None, None, day, True, None, "z", "d"), (None, "", None, True, 2, "a", "e"), (None, "", day, None, 2, None, "f"),
         (None, "", day, None, 2, None, "g")], "k int, s string, d date, t boolean, v int, w string, x string")
    got = quality.latest_version(df, ["k", "s", "d", "t"], ["v", "w"])
    assert sorted(r["x"] for r in got.collect()) == ["b", "c", "d", "e", "f", "g"] and got.columns == df.columns
    big = spark.range(100_000).select("id", F.lit("f").alias("file"))
    capfd.readouterr()
    quality.latest_version(big, ["id"], ["file"]).explain("extended")
    plan = capfd.readouterr().out
    joined = plan[plan.index("Physical Plan"):]
    assert "coalesce(file" not in joined and "isnull(file" not in joined


def test_refresh_joins_the_lines_once(spark, monkeypatch):
    """Datasets over completed lines are built from the published product_sales, with the rows of the star."""
    star, made = td.load_star(spark, SF001), []
    loc, alone = shared_dir(spark, "test-lines"), shared_dir(spark, "test-lines-alone")
    real = DS.sales.completed_lines
    monkeypatch.setattr(DS.sales, "completed_lines", lambda *a, **k: made.append(1) or real(*a, **k))
    names = ["top_products", "category_performance", "daily_rollup", "order_sets"]
    res = DS.refresh_datasets(spark, star, loc, [*names, "product_sales"]).collect()
    assert [r["dataset"] for r in res] == [*names, "product_sales"] and {r["status"] for r in res} == {"ok"} and not made
    for name in names:
        DS.create_dataset(spark, name, star, alone)
        a, b = DS.read_dataset(spark, name, loc), DS.read_dataset(spark, name, alone)
        assert a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert len(made) == len(names)


def test_a_month_is_written_by_few_tasks(spark):
    star, loc = td.load_star(spark, SF001), shared_dir(spark, "test-months")
    by_hash = DS.Dataset("daily_sales", lambda s: DS.REGISTRY["daily_rollup"].build(s).repartition(8), by_month=True)
    base = f"{loc}/months"
    parts = DS._write(by_hash.build(star), base, 1, True)
    files = [f for p, v in parts.items() for f in os.listdir(local_path(f"{base}/{v}/order_month={p}")) if f.endswith(".parquet")]
    assert len(files) == len(parts)
