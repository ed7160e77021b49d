"""Dataset layer on the sample rows: declared types, direct view,
retention, rollup re-aggregation."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF001
from tests.sample import sample_star
from tillroll.plans import datasets as DS
from tillroll.plans import sales
from tillroll.schemas import DATASET_SCHEMAS
from tillroll.session import child_names, path_exists, shared_dir
from tillroll.sources import testdata as td


def test_conform_gives_declared_columns_and_types(spark):
    star = sample_star(spark)
    for name, cols in DATASET_SCHEMAS.items():
        df = DS.build(name, star)
        assert [(f.name, f.dataType) for f in df.schema.fields] == list(cols), name


def test_dataset_view_is_direct(spark):
    star = sample_star(spark)
    view = DS.dataset_view(spark, "daily_sales", star)
    assert view.count() == 4
    assert spark.sql("SELECT SUM(orders) FROM daily_sales").first()[0] == 8


def test_retain_keeps_the_window(spark):
    star = sample_star(spark)
    kept = DS.retain(DS.build("daily_sales", star), "order_date", "2024-01-18", 2)
    assert sorted(r[0] for r in kept.select("order_date").collect()) == [dt.date(2024, 1, 17), dt.date(2024, 1, 18)]


def test_rollup_reaggregates_to_category_performance(spark):
    star = sample_star(spark)
    from_rollup = DS.category_from_rollup(DS.daily_rollup(star))
    direct = sales.category_performance(star.order_items, star.products, star.orders)
    cols = ["category", "orders", "units_sold", "revenue", "cost", "profit"]
    assert sorted(map(tuple, from_rollup.select(*cols).collect())) == sorted(map(tuple, direct.select(*cols).collect()))
    assert isinstance(DS.daily_rollup(star).schema["orders"].dataType, T.LongType)
    assert DS.daily_rollup(star).agg(F.sum("lines")).first()[0] == 13   # lines of completed orders


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


def test_every_dataset_has_declared_columns():
    assert set(DATASET_SCHEMAS) == set(DS.REGISTRY)


def changed(star, month, since):
    """The star with one month's orders gone and the amounts from a day on doubled."""
    o = star.orders.where(F.trunc("order_date", "month") != F.lit(month))
    o = o.withColumn("total_amount", F.when(F.col("order_date") >= F.lit(since), F.col("total_amount") * 2)
                     .otherwise(F.col("total_amount")).cast(star.orders.schema["total_amount"].dataType))
    return td.Star(orders=o, order_items=star.order_items, customers=star.customers, products=star.products)


@pytest.mark.parametrize("name", ["daily_sales", "daily_rollup", "order_sets"])
def test_incremental_refresh_drops_emptied_months(spark, name):
    star, loc = td.load_star(spark, SF001), shared_dir(spark, "test-emptied")
    DS.create_dataset(spark, name, star, loc)
    before = rows(DS.read_dataset(spark, name, loc))
    months = sorted(DS.manifest(spark, f"{loc}/{name}").parts)
    gone = months[-3]
    new = changed(star, gone, gone)
    reader = DS.read_dataset(spark, name, loc)                  # planned before the refresh
    DS.refresh_incremental(spark, name, new, loc, gone)
    assert rows(DS.read_dataset(spark, name, loc)) == rows(DS.build(name, new)) != before
    assert rows(reader) == before                               # its files are still there
    assert sorted(DS.manifest(spark, f"{loc}/{name}").parts) == [m for m in months if m != gone]
    DS.refresh_incremental(spark, name, star, loc, months=[gone])       # one month comes back
    assert gone in DS.manifest(spark, f"{loc}/{name}").parts


def test_refresh_that_lost_the_race_raises(spark):
    star, loc = sample_star(spark), shared_dir(spark, "test-race")
    DS.create_dataset(spark, "daily_sales", star, loc)
    base = f"{loc}/daily_sales"
    stale = DS.manifest(spark, base)
    DS.create_dataset(spark, "daily_sales", star, loc)
    with pytest.raises(DS.ConcurrentRefresh):
        DS._publish(spark, base, DS.Manifest(stale.version + 1, stale.parts))
    assert DS.read_dataset(spark, "daily_sales", loc).count() == 4


def test_retention_deletes_files(spark):
    star, loc = td.load_star(spark, SF001), shared_dir(spark, "test-retention")
    DS.create_dataset(spark, "daily_sales", star, loc)
    base = f"{loc}/daily_sales"
    old = DS.manifest(spark, base)
    last = star.orders.agg(F.max(F.to_date("order_date")).cast("string")).first()[0]
    dropped = DS.retain_dataset(spark, "daily_sales", loc, last, 90)
    assert rows(DS.read_dataset(spark, "daily_sales", loc)) == rows(DS.retain(DS.build("daily_sales", star), "order_date", last, 90))
    assert dropped and all(not path_exists(spark, DS._folder(base, old.parts[m], m)) for m in dropped)
    assert len(DS._versions(spark, base)) == 1
    assert DS.retain_dataset(spark, "daily_sales", loc, "1900-01-01", 3) and DS.read_dataset(spark, "daily_sales", loc).count() == 0
    assert [n for n in child_names(spark, base) if n.startswith("v=")] == []


def test_unused_versions_are_deleted(spark):
    star, loc = sample_star(spark), shared_dir(spark, "test-vacuum")
    for _ in range(4):
        DS.create_dataset(spark, "sales_by_region", star, loc)
    assert len([n for n in child_names(spark, f"{loc}/sales_by_region") if n.startswith("v=")]) == 2


def test_refresh_from_store_follows_the_loads(spark):
    """An order moves to another month by a later file: both months are rebuilt, its old one is emptied."""
    import os

    from tests.sample import CUSTOMERS, ORDER_ITEMS, ORDERS, PRODUCTS, csv_text
    from tests.test_ingest import CUSTOMERS_HEADER, ITEMS_HEADER, ORDERS_HEADER, PRODUCTS_HEADER
    from tillroll.session import local_path
    from tillroll.sources import ingest as I
    root = shared_dir(spark, "test-store-refresh")
    land, store, loc = f"{root}/landing", I.Store(f"{root}/store"), f"{root}/out"

    def load(t, name, text):
        os.makedirs(local_path(f"{land}/{t}"), exist_ok=True)
        with open(f"{local_path(land)}/{t}/{name}", "w") as f:
            f.write(text)
        I.ingest(spark, t, f"{land}/{t}", store)
    extra = [(1, "C001", "2023-11-05 10:00:00", "10.00", "completed", "us-east"), (2, "C001", "2023-12-05 10:00:00", "20.00", "completed", "us-east")]
    load("orders", "a.csv", csv_text(ORDERS_HEADER, [*ORDERS, *extra]))
    load("order_items", "a.csv", csv_text(ITEMS_HEADER, [*ORDER_ITEMS, (1, "P101", 1, "10.00", "0.00"), (2, "P101", 1, "20.00", "0.00")]))
    load("customers", "a.csv", csv_text(CUSTOMERS_HEADER, CUSTOMERS))
    load("products", "a.csv", csv_text(PRODUCTS_HEADER, PRODUCTS))
    names = ["daily_sales", "daily_rollup"]
    for n in names:
        assert DS.refresh_from_store(spark, n, store, loc) is None       # first build
        assert DS.refresh_from_store(spark, n, store, loc) == []         # nothing new
    load("orders", "b.csv", csv_text(ORDERS_HEADER, [(1, "C001", "2023-12-07 10:00:00", "11.00", "completed", "us-east")]))
    for n in names:
        assert DS.refresh_from_store(spark, n, store, loc) == ["2023-11-01", "2023-12-01"]
        assert rows(DS.read_dataset(spark, n, loc)) == rows(DS.build(n, I.star_from_store(spark, store)))
        assert sorted(DS.manifest(spark, f"{loc}/{n}").parts) == ["2023-12-01", "2024-01-01"]


def test_orders_across_categories(spark):
    """Distinct orders over any choice of categories, from the sets, equal the direct count."""
    star = td.load_star(spark, SF001)
    sets = DS.build("order_sets", star)
    lines = sales.completed_lines(star.order_items, star.products, star.orders, keep=("region",))
    cats = [r[0] for r in star.products.select("category").distinct().orderBy("category").collect()]
    for choice in (None, cats[:1], cats[:2], cats[1:4]):
        want = lines if choice is None else lines.where(F.col("category").isin(choice))
        assert rows(DS.orders_from_sets(sets, ["region"], choice)) == rows(want.groupBy("region").agg(F.countDistinct("order_id")))
