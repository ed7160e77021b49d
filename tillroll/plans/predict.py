"""Forecast and anomaly detection (M1-M4), as grouped aggregates.

Regression: ordinary least squares of a daily measure on the day number,
one fit per series. The five sums (n, Sx, Sy, Sxy, Sxx, Syy) are exact
DECIMAL aggregates with partial aggregation, so any number of days and
series fit in one shuffle of tiny per-task partials, and the result does
not depend on summation order. Slope, intercept and residual standard
error follow in closed form; the interval is +/- 1.96 standard errors.
Series points are the days with activity (a decision: gaps are not zeros).

Anomalies: z-score of each day against the trailing 28 calendar days
(excluding the day itself), per series; the window partitions by series
and orders by day, so a partition holds one row per active day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.columns import completed

EPOCH = "1970-01-01"
BIG = "decimal(38,2)"

# Forecast horizon, interval width, anomaly window and cut-offs.
HORIZON_DAYS = 30
Z_INTERVAL = 1.96
TRAILING_DAYS = 28
MIN_PRIOR_POINTS = 7
Z_THRESHOLD = 3.0


def day_number(d: Column) -> Column:
    return F.datediff(d, F.lit(EPOCH).cast("date")).cast("long")


def daily_series(df: DataFrame, keys: list[str], measure: Column, date_col: str = "order_date") -> DataFrame:
    """(keys..., day, x, y): the measure aggregated per series and day."""
    d = F.to_date(date_col)
    return (df.groupBy(*keys, d.alias("day"))
            .agg(measure.alias("y"))
            .withColumn("x", day_number(F.col("day"))))


def linear_fit(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: n, slope, intercept, residual standard error, last day."""
    y = F.col("y").cast(BIG)
    x = F.col("x").cast("decimal(20,0)")
    s = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        F.max("day").alias("last_day"))
    n = F.col("n").cast("decimal(20,0)")
    num = n * F.col("sxy") - F.col("sx") * F.col("sy")      # exact
    den = n * F.col("sxx") - F.col("sx") * F.col("sx")      # exact
    q = n * F.col("syy") - F.col("sy") * F.col("sy")        # exact
    slope = F.try_divide(num.cast("double"), den.cast("double"))
    return (s.withColumn("slope", slope)
            .withColumn("intercept", (F.col("sy").cast("double") - F.col("slope") * F.col("sx").cast("double"))
                        / F.col("n").cast("double"))
            .withColumn("sse", F.greatest(F.lit(0.0), (q.cast("double") - F.try_divide(
                num.cast("double") * num.cast("double"), den.cast("double"))) / F.col("n").cast("double")))
            .withColumn("std_error", F.when(F.col("n") > 2, F.sqrt(F.col("sse") / (F.col("n") - 2).cast("double"))))
            .select(*keys, "n", "slope", "intercept", "std_error", "last_day"))


def forecast(fit: DataFrame, keys: list[str], horizon: int = HORIZON_DAYS) -> DataFrame:
    """Next ``horizon`` days after each series' last day, with the interval."""
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")
    f = fit.where(F.col("slope").isNotNull()).select("*", h)
    day = F.date_add("last_day", F.col("h"))
    yhat = F.col("intercept") + F.col("slope") * day_number(day).cast("double")
    return f.select(*keys, day.alias("forecast_date"),
                    F.round(yhat, 2).alias("forecast"),
                    F.round(yhat - Z_INTERVAL * F.col("std_error"), 2).alias("lower"),
                    F.round(yhat + Z_INTERVAL * F.col("std_error"), 2).alias("upper"))


def revenue_forecast(orders: DataFrame, keys=("region",), horizon: int = HORIZON_DAYS) -> DataFrame:
    """M1: completed daily revenue per series, next ``horizon`` days."""
    keys = list(keys)
    s = daily_series(completed(orders), keys, F.sum("total_amount"))
    return forecast(linear_fit(s, keys), keys, horizon)


def demand_forecast(product_sales: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """M3: completed daily units per product, next ``horizon`` days
    (products with at least three sales days)."""
    s = daily_series(completed(product_sales), ["product_id"], F.sum("quantity"))
    fit = linear_fit(s, ["product_id"]).where(F.col("n") >= 3)
    return forecast(fit, ["product_id"], horizon)


def zscores(series: DataFrame, keys: list[str], days: int = TRAILING_DAYS) -> DataFrame:
    """Trailing mean / std (exact window sums) and z of each day."""
    w = Window.partitionBy(*keys).orderBy("x").rangeBetween(-days, -1)
    y = F.col("y").cast(BIG)
    s = (series.withColumn("pn", F.count(F.lit(1)).over(w))
         .withColumn("ps", F.sum(y).over(w))
         .withColumn("pss", F.sum(y * y).over(w)))
    n = F.col("pn").cast("decimal(20,0)")
    mean = F.try_divide(F.col("ps").cast("double"), F.col("pn").cast("double"))
    var = F.try_divide((n * F.col("pss") - F.col("ps") * F.col("ps")).cast("double"),
                       (F.col("pn") * (F.col("pn") - 1)).cast("double"))
    std = F.sqrt(var)
    z = F.try_divide(F.col("y").cast("double") - mean, std)
    # mean, std and z come from exact sums by single IEEE operations, so
    # they are reproducible bit for bit; no rounding needed.
    return s.select(*keys, "day", F.col("y").alias("value"), F.col("pn").alias("prior_points"),
                    mean.alias("trailing_mean"), std.alias("trailing_std"), z.alias("z"))


def flag(z: DataFrame) -> DataFrame:
    return z.withColumn("is_anomaly", (F.col("prior_points") >= MIN_PRIOR_POINTS)
                        & F.coalesce(F.abs(F.col("z")) >= Z_THRESHOLD, F.lit(False)))


def revenue_anomalies(orders: DataFrame, keys=("region",), only_anomalies: bool = True) -> DataFrame:
    """M2: days whose completed revenue departs from the trailing 28 days."""
    keys = list(keys)
    z = flag(zscores(daily_series(completed(orders), keys, F.sum("total_amount")), keys))
    return z.where("is_anomaly") if only_anomalies else z


def order_volume_anomalies(orders: DataFrame, keys=("region",), only_anomalies: bool = True) -> DataFrame:
    """M4: as M2 on the daily number of orders (all statuses)."""
    keys = list(keys)
    z = flag(zscores(daily_series(orders, keys, F.countDistinct("order_id")), keys))
    return z.where("is_anomaly") if only_anomalies else z
