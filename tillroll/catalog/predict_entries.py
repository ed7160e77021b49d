"""Catalog: forecasts and anomalies M1-M4."""

from __future__ import annotations

from tillroll.catalog.common import oracle, out
from tillroll.operators import joins
from tillroll.plans import predict as P
from tillroll.sources import testdata as td


def _fit_sql(series: str, keys: str) -> str:
    """Closed-form OLS over exact DECIMAL sums, mirroring predict.linear_fit."""
    return f"""fit_sums AS (
  SELECT {keys}, COUNT(*) AS n, SUM(CAST(x AS DECIMAL(38,0))) AS sx, SUM(CAST(y AS DECIMAL(38,2))) AS sy,
         SUM(CAST(x AS DECIMAL(38,0)) * CAST(y AS DECIMAL(38,2))) AS sxy,
         SUM(CAST(x AS DECIMAL(38,0)) * CAST(x AS DECIMAL(38,0))) AS sxx,
         SUM(CAST(y AS DECIMAL(38,2)) * CAST(y AS DECIMAL(38,2))) AS syy, MAX(day) AS last_day
  FROM {series} GROUP BY {keys}),
fit_parts AS (
  SELECT *, CAST(CAST(n AS DECIMAL(38,0)) * sxy - sx * sy AS DOUBLE) AS num,
         CAST(CAST(n AS DECIMAL(38,0)) * sxx - sx * sx AS DOUBLE) AS den,
         CAST(CAST(n AS DECIMAL(38,0)) * syy - sy * sy AS DOUBLE) AS q
  FROM fit_sums),
fit AS (
  SELECT *, num / NULLIF(den, 0) AS slope,
         (CAST(sy AS DOUBLE) - (num / NULLIF(den, 0)) * CAST(sx AS DOUBLE)) / CAST(n AS DOUBLE) AS intercept,
         CASE WHEN n > 2 THEN sqrt(greatest(0.0, (q - (num * num) / NULLIF(den, 0)) / CAST(n AS DOUBLE))
                                   / CAST(n - 2 AS DOUBLE)) END AS std_error
  FROM fit_parts)"""


def _forecast_sql(keys: str, where: str = "") -> str:
    # "+ 0.0" turns DuckDB's -0.0 (ROUND of a tiny negative) into 0.0, as Spark's round gives.
    yhat = ("intercept + slope * CAST(date_diff('day', DATE '1970-01-01', "
            "CAST(last_day + CAST(h AS INTEGER) AS DATE)) AS DOUBLE)")
    return f"""
SELECT {keys}, CAST(last_day + CAST(h AS INTEGER) AS DATE) AS forecast_date,
       ROUND({yhat}, 2) + 0.0 AS forecast,
       ROUND({yhat} - 1.96 * std_error, 2) + 0.0 AS lower,
       ROUND({yhat} + 1.96 * std_error, 2) + 0.0 AS upper
FROM (SELECT *, UNNEST(range(1, {P.HORIZON_DAYS + 1})) AS h FROM fit) f
WHERE slope IS NOT NULL {where}"""


def _m1(spark, sf):
    return out(P.revenue_forecast(td.orders(spark, sf)))


M1_SQL = oracle(_forecast_sql("region"), """rev_series AS (
  SELECT region, CAST(order_date AS DATE) AS day, SUM(total_amount) AS y,
         CAST(date_diff('day', DATE '1970-01-01', CAST(order_date AS DATE)) AS BIGINT) AS x
  FROM star_orders WHERE status = 'completed' GROUP BY 1, 2, 4),
""" + _fit_sql("rev_series", "region"))


def _m3(spark, sf):
    ps = joins.product_sales(td.order_items(spark, sf), td.products(spark, sf), td.orders_plain(spark, sf))
    return out(P.demand_forecast(ps))


M3_SQL = oracle(_forecast_sql("product_id", "AND n >= 3"), """unit_series AS (
  SELECT oi.product_id, CAST(o.order_date AS DATE) AS day, SUM(oi.quantity) AS y,
         CAST(date_diff('day', DATE '1970-01-01', CAST(o.order_date AS DATE)) AS BIGINT) AS x
  FROM star_items oi JOIN star_products p ON oi.product_id = p.product_id
  JOIN star_orders_plain o ON oi.order_id = o.order_id
  WHERE o.status = 'completed' GROUP BY 1, 2, 4),
""" + _fit_sql("unit_series", "product_id"))


def _z_sql(series: str, value: str = "y") -> str:
    return f"""
SELECT region, day, value, prior_points, mean AS trailing_mean, std AS trailing_std, z,
       (prior_points >= {P.MIN_PRIOR_POINTS} AND COALESCE(abs(z) >= {P.Z_THRESHOLD}, FALSE)) AS is_anomaly
FROM (
  SELECT *, (CAST(value AS DOUBLE) - mean) / NULLIF(std, 0) AS z FROM (
    SELECT *, ps / NULLIF(CAST(prior_points AS DOUBLE), 0) AS mean,
           sqrt(CAST(CAST(prior_points AS DECIMAL(38,0)) * pss - ps_d * ps_d AS DOUBLE)
                / NULLIF(CAST(prior_points * (prior_points - 1) AS DOUBLE), 0)) AS std
    FROM (
      SELECT region, day, {value} AS value,
             COUNT(*) OVER w AS prior_points,
             CAST(SUM(CAST(y AS DECIMAL(38,2))) OVER w AS DOUBLE) AS ps,
             SUM(CAST(y AS DECIMAL(38,2))) OVER w AS ps_d,
             SUM(CAST(y AS DECIMAL(38,2)) * CAST(y AS DECIMAL(38,2))) OVER w AS pss
      FROM {series}
      WINDOW w AS (PARTITION BY region ORDER BY x RANGE BETWEEN {P.TRAILING_DAYS} PRECEDING AND 1 PRECEDING)
    ) a) b) c"""


def _m2(spark, sf):
    return out(P.revenue_anomalies(td.orders(spark, sf), only_anomalies=False))


M2_SQL = oracle(_z_sql("rev_series", "CAST(y AS DOUBLE)"), """rev_series AS (
  SELECT region, CAST(order_date AS DATE) AS day, SUM(total_amount) AS y,
         CAST(date_diff('day', DATE '1970-01-01', CAST(order_date AS DATE)) AS BIGINT) AS x
  FROM star_orders WHERE status = 'completed' GROUP BY 1, 2, 4)""")


def _m4(spark, sf):
    return out(P.order_volume_anomalies(td.orders(spark, sf), only_anomalies=False))


M4_SQL = oracle(_z_sql("vol_series"), """vol_series AS (
  SELECT region, CAST(order_date AS DATE) AS day, COUNT(DISTINCT order_id) AS y,
         CAST(date_diff('day', DATE '1970-01-01', CAST(order_date AS DATE)) AS BIGINT) AS x
  FROM star_orders GROUP BY 1, 2, 4)""")

ENTRIES = {
    "m1_revenue_forecast": (_m1, M1_SQL),
    "m2_revenue_anomalies": (_m2, M2_SQL),
    "m3_demand_forecast": (_m3, M3_SQL),
    "m4_order_volume_anomalies": (_m4, M4_SQL),
}
