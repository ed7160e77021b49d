"""Registry of every implemented operator as a runnable query.

Each entry maps a key (operator id + name) to ``(builder, oracle_sql)``:
``builder(spark, sf_dir) -> DataFrame`` reads the driver tables, and
``oracle_sql`` is the same computation in ANSI SQL for DuckDB (or None
where SQL cannot express it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.catalog import (  # noqa: F401
    sales_entries, metric_entries, filter_entries, quality_entries,
    predict_entries, ingest_entries, stream_entries,
)

Builder = Callable[[SparkSession, str], DataFrame]

_MODULES = [sales_entries, metric_entries, filter_entries, quality_entries,
            predict_entries, ingest_entries, stream_entries]


def entries() -> dict[str, tuple[Builder, str | None]]:
    out: dict[str, tuple[Builder, str | None]] = {}
    for m in _MODULES:
        for k, v in m.ENTRIES.items():
            if k in out:
                raise ValueError(f"duplicate query key {k}")
            out[k] = v
    return out
