"""Merged daily sketches against exact counts and ranks."""

import random

from pyspark.sql import functions as F

from basketry.operators import features, sketches
from tests.builders import DAY, NOW, events, products, rows


def history(n=3000, seed=1):
    draw = random.Random(seed)
    return [(draw.choice("AB"), f"c{draw.randrange(700)}", "click", draw.choice([None, "p", "q", "r", f"x{draw.randrange(900)}"]), NOW - draw.randrange(20) * DAY)
            for _ in range(n)]


def near(about, exact):
    return abs(about - exact) <= max(1, 3 * sketches.DISTINCT_ERROR * exact)


def test_ranges_of_days_and_merged_categories(spark):
    held, pr = history(), products(spark, [("p", "A", "x"), ("q", "A", "y"), ("p", "B", "x")])
    daily = sketches.daily_distincts(events(spark, held), pr)
    category = {("p", "A"): "x", ("q", "A"): "y", ("p", "B"): "x"}
    for days, by in ((range(20), ["tenant_id", "category"]), (range(3, 9), ["tenant_id", "category"]), (range(3, 9), ["tenant_id"])):
        last, first = ((NOW - d * DAY).date() for d in (min(days), max(days)))
        want = {}
        for t, c, _, p, at in held:
            if first <= at.date() <= last:
                key = (t, category.get((p, t))) if len(by) == 2 else (t,)
                customers, named, n = want.setdefault(key, (set(), set(), []))
                customers.add(c)
                named.add(p)
                n.append(1)
        got = {tuple(r[c] for c in by): r for r in sketches.distincts_between(daily, first, last, by).collect()}
        assert set(got) == set(want)
        for key, (customers, named, n) in want.items():
            assert near(got[key].customers, len(customers)) and near(got[key].products, len(named - {None})) and got[key].events == len(n)


def test_approximate_counts_of_customers(spark):
    ev, pr = events(spark, history(500)), products(spark, [("p", "A", "x"), ("q", "A", "y"), ("p", "B", "x")])
    columns = ["tenant_id", "customer_id", "distinct_products_viewed", "distinct_categories_viewed"]
    assert rows(features.distinct_counts(ev, pr, approximate=True), *columns) == rows(features.distinct_counts(ev, pr), *columns)
    none = features.distinct_counts(ev.limit(0), pr, approximate=True)
    assert none.count() == 0 and none.columns == features.distinct_counts(ev, pr).columns


def test_quantiles_of_ranges(spark):
    draw = random.Random(2)
    held = [("A", draw.choice("uv"), draw.choice([draw.expovariate(0.01), 5.0]), NOW - draw.randrange(10) * DAY) for _ in range(20000)]
    log = spark.createDataFrame([*held, ("A", "u", None, NOW), ("A", "u", float("nan"), NOW)], "tenant_id STRING, surface STRING, latency_ms DOUBLE, created_at TIMESTAMP")
    daily = sketches.daily_quantiles(log)
    assert daily.groupBy("surface").count().collect()[0]["count"] == 10
    last, first = (NOW - 2 * DAY).date(), (NOW - 7 * DAY).date()
    for r in sketches.quantiles_between(daily, [0.0, 0.5, 0.99, 1.0], first, last).collect():
        values = sorted(v for _, s, v, at in held if s == r.surface and first <= at.date() <= last)
        slack = 2 * sketches.RANK_ERROR * len(values) + 1
        assert r.requests == len(values)
        assert sum(v < r.value for v in values) - slack <= r.share * len(values) <= sum(v <= r.value for v in values) + slack


def test_sketch_rows_are_bounded(spark):
    log = spark.range(200_000).select(F.lit("A").alias("tenant_id"), F.lit("u").alias("surface"), F.col("id").cast("double").alias("latency_ms"), F.lit(NOW).alias("created_at"))
    one = sketches.daily_quantiles(log).select(F.length("sketch").alias("n")).first()
    assert one.n < 20_000
