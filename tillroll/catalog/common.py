"""Helpers shared by the catalog entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.testdata import oracle  # noqa: F401  (re-export)


def out(df: DataFrame) -> DataFrame:
    """Normalise result types for comparison: DECIMAL -> DOUBLE, INT -> BIGINT.

    Decimal aggregates are exact, so the cast gives the same double in any
    engine.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) or isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
