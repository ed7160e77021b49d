"""Published datasets.

A dataset is a named builder over the star schema plus a declared output
schema. ``create_dataset`` materialises one as Parquet (the in-memory
"import" mode of the reference becomes a columnar file set that readers
scan with pushdown); ``dataset_view`` registers the builder as a temp view
instead (the always-current "direct" mode). ``refresh_datasets`` rebuilds
all of them, each on its own, so one failure does not stop the rest.

A dataset's files are immutable: every build writes a new version folder, and
a small manifest, published by renaming it into place, says which version
holds each part. Readers take the newest manifest, so they see the state
before or after a refresh and never between, and a failed rebuild leaves the
published state as it was. Two refreshes at once cannot both win: the second
finds its manifest's number taken and raises.

Date-keyed datasets are partitioned by month (a day partition would hold a
single row of daily_sales). ``refresh_incremental`` rebuilds the changed months
only and drops those that have become empty; ``refresh_from_store`` finds the
changed months from the load batches that the manifest does not know yet.
``retain`` drops old months from the manifest and ``vacuum`` deletes the
folders that no kept manifest refers to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.columns import completed, line_cost, line_revenue, lit_date
from tillroll.operators import filters, joins
from tillroll.plans import sales
from tillroll.schemas import DATASET_SCHEMAS
from tillroll.session import child_names, delete_path, publish_small, read_small
from tillroll.sources import ingest
from tillroll.sources.testdata import Star


PART_COL = "order_month"
LINES = "product_sales"   # the dataset of joined lines


@dataclass
class Dataset:
    name: str
    build: Callable[[Star], DataFrame]
    by_month: bool = False
    of_lines: Callable[[DataFrame], DataFrame] | None = None   # the same from the star's completed lines


def _owc(star: Star) -> DataFrame:
    return joins.orders_with_customers(star.orders, star.customers)


def _ps(star: Star) -> DataFrame:
    return joins.product_sales(star.order_items, star.products, star.orders)


def daily_rollup(star: Star) -> DataFrame:
    """Completed lines pre-aggregated per day x region x category.

    revenue, cost, units and lines re-aggregate exactly along any axis.
    ``orders`` (distinct orders in the cell) re-aggregates exactly along
    day and region (an order has one day and one region) but not across
    categories (an order can span several): ``order_sets`` does that.
    """
    return rollup_of(_lines(star))


def _lines(star: Star) -> DataFrame:
    return sales.completed_lines(star.order_items, star.products, star.orders, keep=("order_date", "region"))


def rollup_of(lines: DataFrame) -> DataFrame:
    """S20 over completed lines."""
    return (lines.groupBy(F.to_date("order_date").alias("order_date"), "region", "category")
            .agg(F.sum(line_revenue()).alias("revenue"), F.sum(line_cost()).alias("cost"),
                 F.sum("quantity").alias("units_sold"), F.count(F.lit(1)).alias("lines"),
                 F.countDistinct("order_id").alias("orders")))


def order_sets(star: Star) -> DataFrame:
    """Completed orders counted per day x region x set of categories.

    Every order is in one row, that of the exact set of categories it holds,
    so distinct orders re-aggregate along every axis: the orders of any choice
    of categories are the sum over the sets that meet it. A set is at most the
    list of categories. (Bitmaps of order ids would need 4 kB per cell and
    32,768 ids, where a cell of one day holds a few orders.)
    """
    return sets_of(_lines(star))


def sets_of(lines: DataFrame) -> DataFrame:
    """``order_sets`` over completed lines."""
    sets = (lines.groupBy("order_id", F.to_date("order_date").alias("order_date"), "region")
            .agg(F.array_sort(F.collect_set("category")).alias("categories")))
    return sets.groupBy("order_date", "region", "categories").agg(F.count(F.lit(1)).alias("orders"))


def orders_from_sets(sets: DataFrame, by: list[str], categories: list[str] | None = None) -> DataFrame:
    """Distinct orders per ``by`` (of order_date, region) with a line in any of ``categories`` (None: in any)."""
    if categories is not None:
        sets = sets.where(F.arrays_overlap("categories", F.array(*[F.lit(c) for c in categories])))
    return sets.groupBy(*by).agg(F.sum("orders").alias("orders"))


def category_from_rollup(rollup: DataFrame) -> DataFrame:
    """A5 answered from the S20 rollup instead of the line items."""
    return (rollup.groupBy("category")
            .agg(F.sum("orders").alias("orders"), F.sum("units_sold").alias("units_sold"),
                 F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"))
            .withColumn("profit", F.col("revenue") - F.col("cost")))


REGISTRY: dict[str, Dataset] = {d.name: d for d in [
    Dataset("sales_by_region", lambda s: sales.sales_by_region(s.orders)),
    Dataset("top_products", lambda s: sales.top_products(s.order_items, s.products, s.orders), of_lines=sales.top_products_of),
    Dataset("customer_segments", lambda s: sales.customer_segments(s.customers, s.orders)),
    Dataset("daily_sales", lambda s: sales.daily_sales(s.orders), by_month=True),
    Dataset("category_performance", lambda s: sales.category_performance(s.order_items, s.products, s.orders),
            of_lines=sales.category_performance_of),
    Dataset("orders_with_customers", _owc),
    Dataset("product_sales", _ps),
    Dataset("daily_rollup", daily_rollup, by_month=True, of_lines=rollup_of),
    Dataset("order_sets", order_sets, by_month=True, of_lines=sets_of),
]}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select the declared output columns with their declared types."""
    cols = DATASET_SCHEMAS.get(name)
    if not cols:
        return df
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in cols])


def build(name: str, star: Star, lines: DataFrame | None = None) -> DataFrame:
    """A dataset from the star, or from its completed lines where these are given and enough for it."""
    ds = REGISTRY[name]
    return conform(ds.build(star) if lines is None or ds.of_lines is None else ds.of_lines(lines), name)


@dataclass
class Manifest:
    """The published state: which folder holds each part (a month, or the empty
    name where there are no months), and the load batches it reflects."""
    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, list[int]] = field(default_factory=dict)


class ConcurrentRefresh(RuntimeError):
    """Another refresh of the dataset was published first."""


def _base(location: str, name: str) -> str:
    return f"{location.rstrip('/')}/{name}"


def _versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n[:-5]) for n in child_names(spark, f"{base}/manifest") if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, base: str, version: int | None = None) -> Manifest | None:
    """A published manifest, by default the newest (None before the first)."""
    if version is None:
        have = _versions(spark, base)
        if not have:
            return None
        version = have[-1]
    return Manifest(**json.loads(read_small(spark, f"{base}/manifest/{version}.json")))


def _publish(spark: SparkSession, base: str, m: Manifest) -> None:
    if not publish_small(spark, f"{base}/manifest/{m.version}.json", json.dumps(m.__dict__)):
        raise ConcurrentRefresh(f"{base}: version {m.version} has been published by another refresh")
    vacuum(spark, base, keep=2)


def _folder(base: str, folder: str, part: str) -> str:
    return f"{base}/{folder}" + (f"/{PART_COL}={part}" if part else "")


def _write(df: DataFrame, base: str, version: int, by_month: bool) -> dict[str, str]:
    """Write a folder of its own for a version to be; returns its parts."""
    folder = f"v={version}-{uuid.uuid4().hex[:8]}"
    spark, path = df.sparkSession, f"{base}/{folder}"
    if not by_month:
        df.write.parquet(path)
        return {"": folder}
    # months dealt to tasks, large ones to several: not a file of every month from every task
    by = df.withColumn(PART_COL, F.trunc("order_date", "month")).hint("rebalance", F.col(PART_COL))
    by.write.partitionBy(PART_COL).parquet(path)
    found = [n.split("=", 1)[1] for n in child_names(spark, path) if n.startswith(f"{PART_COL}=")]
    return {month: folder for month in found}


def vacuum(spark: SparkSession, base: str, keep: int = 1) -> None:
    """Delete manifests but the newest ``keep``, and the folders that none of those refers to."""
    have = _versions(spark, base)
    kept = [manifest(spark, base, v) for v in have[-keep:]]
    used = {_folder(base, v, p) for m in kept for p, v in m.parts.items()}
    for v in have[:-keep]:
        delete_path(spark, f"{base}/manifest/{v}.json")
    newest = have[-1] if have else 0
    for n in child_names(spark, base):
        if not n.startswith("v=") or int(n[2:].split("-")[0]) > newest:  # a refresh under way
            continue
        parts = [p for p in child_names(spark, f"{base}/{n}") if p.startswith(f"{PART_COL}=")]
        if f"{base}/{n}" not in used and not any(f"{base}/{n}/{p}" in used for p in parts):
            delete_path(spark, f"{base}/{n}")
            continue
        for p in parts:
            if f"{base}/{n}/{p}" not in used:
                delete_path(spark, f"{base}/{n}/{p}")


def _next(old: Manifest | None) -> int:
    """The version that a refresh starting from ``old`` may publish."""
    return (old.version if old else 0) + 1


def create_dataset(spark: SparkSession, name: str, star: Star, location: str,
                   batches: dict[str, list[int]] | None = None, lines: DataFrame | None = None) -> str:
    """Build and materialise one dataset; returns its folder."""
    base = _base(location, name)
    version = _next(manifest(spark, base))
    parts = _write(build(name, star, lines), base, version, REGISTRY[name].by_month)
    _publish(spark, base, Manifest(version, parts, batches or {}))
    return base


def read_dataset(spark: SparkSession, name: str, location: str) -> DataFrame:
    """The published rows: the folders that the newest manifest names."""
    base = _base(location, name)
    m = manifest(spark, base)
    if m is None:
        raise FileNotFoundError(f"dataset {name} has not been built under {location}")
    folders = [_folder(base, v, p) for p, v in m.parts.items()]
    if not folders:  # every month has been dropped
        return spark.createDataFrame([], ", ".join(f"`{c}` {t.simpleString()}" for c, t in DATASET_SCHEMAS[name]))
    return spark.read.schema(spark.read.parquet(folders[0]).schema).parquet(*folders)


def refresh_datasets(spark: SparkSession, star: Star, location: str,
                     names: list[str] | None = None) -> DataFrame:
    """Rebuild every dataset; a failing one is reported, the rest go on.

    Returns (dataset, status, rows, error). The loop runs over the handful
    of registered datasets; each rebuild is a distributed job. ``product_sales``
    comes first: it is the join of lines, products and orders, and the datasets
    over completed lines are then built from its rows instead of joining the
    same tables again. Without it, or where it fails, they are built from the star.
    """
    names, results, lines = names or list(REGISTRY), {}, None
    for name in sorted(names, key=lambda n: n != LINES):   # stable: the others keep their order
        try:
            create_dataset(spark, name, star, location, lines=lines)
            built = read_dataset(spark, name, location)
            results[name] = (name, "ok", built.count(), None)
            if name == LINES:
                lines = completed(built)
        except Exception as e:  # one failure must not stop the rest
            results[name] = (name, "failed", None, str(e).splitlines()[0][:500])
    rows = [results[name] for name in names]
    return spark.createDataFrame(rows, "dataset string, status string, rows long, error string")


def _months_of(orders: DataFrame, months: list[str]) -> Column:
    """Orders of the given months, as bounds that reach the scan."""
    dtype = orders.schema["order_date"].dataType
    day = lambda m, k: F.add_months(F.lit(m).cast("date"), k).cast(dtype)
    out = F.lit(False)
    for m in months:
        out = out | ((F.col("order_date") >= day(m, 0)) & (F.col("order_date") < day(m, 1)))
    return out


def _restricted(star: Star, where: Column) -> Star:
    return Star(orders=star.orders.where(where), order_items=star.order_items,
                customers=star.customers, products=star.products)


def refresh_incremental(spark: SparkSession, name: str, star: Star, location: str, since=None,
                        months: list[str] | None = None, batches: dict[str, list[int]] | None = None) -> str:
    """Rebuild the months from the month of ``since`` on, or the given
    ``months`` (first days, ``YYYY-MM-01``); the others keep their files.

    The builder runs with the date bounds pushed into its scans. Months that
    have no rows any more leave the manifest.
    """
    ds = REGISTRY[name]
    if not ds.by_month:
        raise ValueError(f"{name} is not partitioned by month")
    base = _base(location, name)
    old = manifest(spark, base)
    if old is None:
        return create_dataset(spark, name, star, location, batches)
    if months is None:
        # since may be an expression over the data (one row): the first month to rebuild
        first = spark.range(1).select(F.trunc(lit_date(since), "month").cast("string").alias("m")).first()["m"]
        where = F.col("order_date") >= F.lit(first).cast("date").cast(star.orders.schema["order_date"].dataType)
        stays = {p: v for p, v in old.parts.items() if p < first}
    else:
        where = _months_of(star.orders, months)
        stays = {p: v for p, v in old.parts.items() if p not in months}
    version = _next(old)
    new = _write(conform(ds.build(_restricted(star, where)), name), base, version, True)
    _publish(spark, base, Manifest(version, {**stays, **new}, batches or old.batches))
    return base


def changed_months(spark: SparkSession, store: ingest.Store, known: dict[str, list[int]]) -> tuple[list[str] | None, dict[str, list[int]]]:
    """Months whose rows differ since the load batches in ``known``, and all batches there are now.

    An order counts with every version of it that was ever loaded, so the
    month it has left is found as well as the one it is in. New customers or
    products can touch any month: None.
    """
    now = {t: sorted(int(n.split("=")[1]) for n in child_names(spark, store.table(t)) if n.startswith("batch_id="))
           for t in ("orders", "order_items", "customers", "products")}
    new = {t: [b for b in now[t] if b not in set(known.get(t, []))] for t in now}
    rows = lambda t: ingest.loaded(spark, store, t).where(F.col("batch_id").isin(new[t]))
    if any(new[t] and not rows(t).isEmpty() for t in ("customers", "products")):
        return None, now
    keys = [rows(t).select("order_id") for t in ("orders", "order_items") if new[t]]
    if not keys:
        return [], now
    touched = keys[0] if len(keys) == 1 else keys[0].union(keys[1])
    found = (ingest.loaded(spark, store, "orders").join(touched.distinct(), "order_id", "left_semi")
             .select(F.trunc("order_date", "month").cast("string").alias("m")).distinct())
    return sorted(r["m"] for r in found.collect() if r["m"]), now  # as many as there are months


def refresh_from_store(spark: SparkSession, name: str, store: ingest.Store, location: str) -> list[str] | None:
    """S15 over an ingest store: rebuild the months that the loads since the
    last refresh have touched, corrections and emptied months included.
    Returns them (None: all of the dataset was rebuilt)."""
    base = _base(location, name)
    old = manifest(spark, base)
    months, now = changed_months(spark, store, old.batches if old else {})
    star = ingest.star_from_store(spark, store)
    if old is None or months is None or not REGISTRY[name].by_month:
        if months != [] or old is None:
            create_dataset(spark, name, star, location, now)
        return None
    if months:
        refresh_incremental(spark, name, star, location, months=months, batches=now)
    return months


def retain(df: DataFrame, date_col: str, as_of, days: int) -> DataFrame:
    """The rows of the last ``days`` days of history up to ``as_of``."""
    return filters.last_days(df, date_col, as_of, days)


def retain_dataset(spark: SparkSession, name: str, location: str, as_of, days: int) -> list[str]:
    """S16 on storage: keep the last ``days`` days up to ``as_of`` of a
    published dataset. Months outside leave the manifest and are deleted; the
    months at the two ends are written anew without the days outside. Returns
    the months dropped."""
    if not REGISTRY[name].by_month:
        raise ValueError(f"{name} is not partitioned by month")
    base = _base(location, name)
    old = manifest(spark, base)
    if old is None:
        raise FileNotFoundError(f"dataset {name} has not been built under {location}")
    last = lit_date(as_of)
    ends = spark.range(1).select(F.date_add(F.date_sub(last, days), 1).cast("string").alias("lo"), last.cast("string").alias("hi")).first()
    lo, hi = ends["lo"][:8] + "01", ends["hi"][:8] + "01"
    inside = {p: v for p, v in old.parts.items() if lo <= p <= hi}
    version = _next(old)
    cut = [p for p in {lo, hi} if p in inside]
    if cut:
        rows = spark.read.parquet(*[_folder(base, inside[p], p) for p in cut])
        trimmed = _write(retain(rows, "order_date", ends["hi"], days), base, version, True)
        inside = {**{p: v for p, v in inside.items() if p not in cut}, **trimmed}
    _publish(spark, base, Manifest(version, inside, old.batches))
    vacuum(spark, base, keep=1)
    return sorted(set(old.parts) - set(inside))


def dataset_view(spark: SparkSession, name: str, star: Star) -> DataFrame:
    """Direct-query mode, a temp view recomputed on every read."""
    df = build(name, star)
    df.createOrReplaceTempView(name)
    return spark.table(name)
