"""Top-N, bottom-N, top-percent and quantile buckets.

``top_n`` / ``bottom_n`` are ORDER BY ... LIMIT n: Spark plans them as
TakeOrderedAndProject, every task keeps only its own n candidates.

``global_rank`` gives each row its exact 1-based position in a total order
without a single-partition window (``Window.orderBy`` with no partition key
would pull every row into one task). The frame is range-partitioned on the
order (AQE may merge adjacent ranges), sorted inside each partition, and each row takes a per-partition
index from ``monotonically_increasing_id`` (partition id in the high bits,
position in the low 33 bits). Per-partition counts - one row per partition
- give the offsets and the total. The ranged frame is checkpointed to the shared
checkpoint folder first, so both uses see the same partitions even if
executors are lost and tasks rerun.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.session import ensure_checkpoint_dir

_LOW33 = (1 << 33) - 1


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def top_n(df: DataFrame, measure: str, n: int, tie: list[str] | None = None) -> DataFrame:
    """the n rows with the largest ``measure`` (ties broken by ``tie``)."""
    order = [F.col(measure).desc_nulls_last()] + _cols(tie or [])
    return df.orderBy(*order).limit(n)


def bottom_n(df: DataFrame, measure: str, n: int, tie: list[str] | None = None) -> DataFrame:
    """the n rows with the smallest ``measure``."""
    order = [F.col(measure).asc_nulls_last()] + _cols(tie or [])
    return df.orderBy(*order).limit(n)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank",
                partitions: int | None = None, total: str | None = None) -> DataFrame:
    """Attach the exact 1-based rank of each row in ``order`` (a total order),
    and with ``total`` also the row count as a column of that name.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Without an explicit count AQE may coalesce adjacent range partitions
    # to its advisory size; coalescing keeps the range order, so partition
    # ids still follow the global order.
    ranged = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order))
    ranged = (ranged
              .sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    ranged = ranged.select("*", F.shiftright("_mid", 33).alias("_pid"),
                           (F.col("_mid").bitwiseAND(F.lit(_LOW33)) + 1).alias("_local"))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # ``counts`` has one row per partition: a bounded, broadcast-sized frame,
    # so its unpartitioned windows are cheap.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy()).alias("_total"))
    out = (ranged.join(F.broadcast(offsets), "_pid")
           .withColumn(name, F.col("_offset") + F.col("_local")))
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop("_mid", "_pid", "_local", "_offset", "_total")


def top_percent(df: DataFrame, measure: str, pct: float, tie: list[str]) -> DataFrame:
    """rows whose rank by ``measure`` (desc, ties by ``tie``) is within
    the top ``ceil(pct * count)``."""
    order = [F.col(measure).desc_nulls_last()] + _cols(tie)
    ranked = global_rank(df, order, "rank", total="_rows")
    return ranked.where(F.col("rank") <= F.ceil(F.col("_rows") * F.lit(pct))).drop("_rows")


def ntile_of(rank: Column, total: Column, k: int) -> Column:
    """SQL NTILE(k) bucket of a 1-based row position among ``total`` rows."""
    size = F.floor(total / k)
    rem = total - size * k
    big = rem * (size + 1)
    return (F.when(rank <= big, F.floor((rank - 1) / (size + 1)) + 1)
            .otherwise(rem + F.floor((rank - big - 1) / size) + 1)).cast("long")


def ntile_global(df: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """NTILE(k) OVER (ORDER BY order) computed without a single-task window."""
    ranked = global_rank(df, order, f"_{name}_rank", total=f"_{name}_rows")
    return (ranked.withColumn(name, ntile_of(F.col(f"_{name}_rank"), F.col(f"_{name}_rows"), k))
            .drop(f"_{name}_rank", f"_{name}_rows"))
