"""Custom operators against brute force: NTILE formula, closed-form
regression, co-occurrence with a giant basket, dedupe with a hot key."""

import itertools
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillroll.operators import joins, quality
from tillroll.operators.ranking import ntile_of
from tillroll.plans import predict as P


def _ntile_reference(n, k):
    """NTILE(k) over n rows: the first n % k buckets hold one extra row."""
    size, rem = divmod(n, k)
    out = []
    for b in range(k):
        out += [b + 1] * (size + (1 if b < rem else 0))
    return out


@settings(max_examples=40, deadline=None)
@given(n=st.integers(min_value=1, max_value=300), k=st.integers(min_value=1, max_value=12))
def test_ntile_formula(spark, n, k):
    df = spark.range(1, n + 1).select(ntile_of(F.col("id"), F.lit(n), k).alias("t"))
    assert [r[0] for r in df.orderBy(F.monotonically_increasing_id()).collect()] == _ntile_reference(n, k)


def test_linear_fit_matches_numpy(spark):
    rnd = random.Random(3)
    rows = []
    for series in ("a", "b"):
        for x in rnd.sample(range(9000, 9400), 60):
            y = Decimal(f"{1000 + 3.5 * (x - 9000) + rnd.uniform(-50, 50):.2f}")
            rows.append((series, x, y))
    df = spark.createDataFrame(rows, "s string, x long, y decimal(18,2)").withColumn("day", F.lit(None).cast("date"))
    fit = {r["s"]: r for r in P.linear_fit(df, ["s"]).collect()}
    for s in ("a", "b"):
        xs = np.array([float(r[1]) for r in rows if r[0] == s])
        ys = np.array([float(r[2]) for r in rows if r[0] == s])
        slope, intercept = np.polyfit(xs, ys, 1)
        resid = ys - (slope * xs + intercept)
        se = np.sqrt((resid ** 2).sum() / (len(xs) - 2))
        assert fit[s]["slope"] == pytest.approx(slope, rel=1e-9)
        assert fit[s]["intercept"] == pytest.approx(intercept, rel=1e-7)
        assert fit[s]["std_error"] == pytest.approx(se, rel=1e-6)


def test_co_occurrence_with_giant_basket(spark):
    rnd = random.Random(5)
    rows = [(0, p) for p in range(300)]                       # one order holding most lines
    rows += [(o, rnd.randint(0, 40)) for o in range(1, 200) for _ in range(rnd.randint(1, 4))]
    items = spark.createDataFrame(rows, "order_id long, product_id long")
    anchors = spark.createDataFrame([(0,), (7,)], "product_id long")
    got = {(r[0], r[1]): r[2] for r in joins.co_occurrence(items, anchors).collect()}
    baskets = {}
    for o, p in rows:
        baskets.setdefault(o, set()).add(p)
    want = Counter()
    for prods in baskets.values():
        for a, b in itertools.permutations(prods, 2):
            if a in (0, 7):
                want[(a, b)] += 1
    assert got == dict(want)


def test_dedupe_with_hot_key(spark):
    rnd = random.Random(9)
    rows = [(1, rnd.randint(0, 10_000), f"v{i}") for i in range(3000)]     # a third of all rows
    rows += [(k, rnd.randint(0, 10_000), f"w{k}") for k in range(2, 6002)]
    df = spark.createDataFrame(rows, "k long, ts long, payload string")
    got = {r["k"]: (r["ts"], r["payload"]) for r in quality.dedupe(df, ["k"], ["ts"]).collect()}
    want = {}
    for k, ts, payload in rows:
        if k not in want or (ts, payload) > want[k]:
            want[k] = (ts, payload)
    assert got == want


def test_distinct_orders_of_repeated_ids_per_level(spark):
    """An order on several days, months and years, in copies, counts once per group at every level."""
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from tillroll.plans import drilldown, metrics
    rng = random.Random(4)
    rows = [(rng.randrange(12), dt.datetime(2023, 1, 1) + dt.timedelta(days=rng.randrange(900)), "completed", 1.0) for _ in range(150)]
    rows += rows[:30] + [(None, dt.datetime(2023, 5, 5), "completed", 2.0), (3, None, "completed", 4.0), (99, dt.datetime(2023, 1, 1), "pending", 9.0)]
    df = spark.createDataFrame(rows, "order_id int, order_date timestamp_ntz, status string, total_amount double")
    done = [(i, t and t.date(), a) for i, t, s, a in rows if s == "completed"]

    def want(of):
        out = {}
        for i, d, a in done:
            g = out.setdefault(of(d), [set(), 0.0])
            g[0] |= {i} - {None}
            g[1] += a
        return {k: (len(s), a) for k, (s, a) in out.items()}
    got = {(r["level"], r["year"], r["quarter"], r["month"], r["day"]): (r["orders"], r["revenue"]) for r in drilldown.time_drilldown(df).collect()}
    parts = lambda d: (d and d.year, d and (d.month + 2) // 3, d and d.month, d)
    for level, n in ((15, 0), (7, 1), (3, 2), (1, 3), (0, 4)):
        here = {k[1:]: v for k, v in got.items() if k[0] == level}
        assert here == want(lambda d: (*parts(d)[:n], *[None] * (4 - n))), level
    week = {r["period"]: (r["orders"], r["revenue"]) for r in metrics.periodic_sales(df).where("grain = 'week'").collect()}
    assert week == want(lambda d: d and d - dt.timedelta(days=d.weekday()))
    geo = df.withColumn("region", F.concat(F.lit("r"), F.day("order_date") % 3)).withColumn("country", F.concat("region", F.day("order_date") % 5))
    flat = [tuple(r) for r in geo.where("status = 'completed'").select("order_id", "region", "country").collect()]
    for r in drilldown.geo_drilldown(geo).collect():
        met = {i for i, a, b in flat if i is not None and (r["level"] == 3 or (a == r["region"] and (r["level"] == 1 or b == r["country"])))}
        assert r["orders"] == len(met), r


def test_left_orders_keeps_everyone(spark):
    from tillroll.plans.sales import customers_left_orders
    c = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "customer_id int, customer_segment string")
    o = spark.createDataFrame([(10, 1), (11, 1), (12, 9), (13, None)], "order_id int, customer_id int")
    assert sorted(map(str, customers_left_orders(c, o).collect())) == sorted(map(str, c.join(o, "customer_id", "left").collect()))
