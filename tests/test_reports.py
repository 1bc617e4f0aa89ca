import random

import pytest
from pyspark.sql import functions as F

from basketry.operators import candidates as cand
from basketry.operators import cooccurrence as co
from basketry.operators import decisions as dec
from basketry.operators import experiments as ab
from basketry.operators import features as feat
from basketry.operators import quality, reports, sessions
from basketry.operators.enrich import enrich_events
from basketry.operators.tenancy import tenant_scope
from basketry.plans.customer_features import customer_features
from tests.builders import DAY, HOUR, MICRO, MINUTE, NOW, cooc, events, products, rows


@pytest.mark.parametrize("tenant,n", [("A", 1), ("", 0), (None, 0), ("C", 0)])
def test_tenant_scope(spark, tenant, n):
    ev = events(spark, [("A", "c", "click", None, NOW), ("B", "c", "click", None, NOW),
                        ("", "c", "click", None, NOW)])
    assert tenant_scope(ev, tenant).count() == n


LEAK_JOBS = {
    "counts": lambda e, p: feat.activity_counts(e),
    "distinct": lambda e, p: feat.distinct_counts(e, p),
    "affinity": lambda e, p: feat.category_affinity_rows(e, p, NOW),
    "gaps": lambda e, p: feat.purchase_gaps(e),
    "revenue": lambda e, p: feat.purchase_revenue(e),
    "sessions": lambda e, p: sessions.session_windows(e),
    "features": lambda e, p: customer_features(e, p, NOW).drop("category_affinity"),
    "basic": lambda e, p: feat.basic_features(e, p, NOW),
    "pairs": lambda e, p: co.cooccurrence(e, NOW),
    "anchors": lambda e, p: cand.recent_anchors(e, NOW),
    "popular": lambda e, p: cand.popularity(e, p, NOW),
    "days": lambda e, p: reports.daily_activity(e),
    "rolling": lambda e, p: reports.rolling_5m_features(e).drop("id"),
}


@pytest.mark.parametrize("name", LEAK_JOBS)
def test_no_tenant_sees_another(spark, name):
    """Tenant A's rows are the same with and without a tenant B of equal ids."""
    mine = [("A", f"c{i % 3}", ("purchase", "product_view")[i % 2], f"p{i % 4}",
             NOW - i * HOUR, '{"revenue": 2}') for i in range(24)]
    theirs = [("B", f"c{i % 3}", "purchase", f"p{i % 4}", NOW - i * MINUTE) for i in range(24)]
    catalogue = [(f"p{i}", "A", f"k{i % 2}") for i in range(4)]
    other = [(f"p{i}", "B", "zzz") for i in range(4)]
    job = LEAK_JOBS[name]
    alone = job(events(spark, mine), products(spark, catalogue))
    shared = job(events(spark, mine + theirs), products(spark, catalogue + other))
    shared = shared.filter("tenant_id = 'A'")
    assert alone.count() > 0
    assert rows(alone, *alone.columns) == rows(shared, *alone.columns)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 500])
def test_percentiles_by_rank(spark, n):
    pick = random.Random(n)
    values = [round(pick.choice([pick.random(), 1000 * pick.random(), 7.25]), 2)
              for _ in range(n)]
    log = spark.createDataFrame([("A", "home", v) for v in values],
                                "tenant_id STRING, surface STRING, latency_ms DOUBLE")
    row = dec.latency_summary(log).first()
    ordered = sorted(values)
    for name, p in dec.PERCENTILES.items():
        assert row[name] == ordered[min(int(n * p), n - 1)], name
    assert (row.requests, row.fastest, row.slowest) == (n, ordered[0], ordered[-1])
    assert row.average == pytest.approx(sum(values) / n)


def test_latency_of_negative_and_missing_values(spark):
    log = spark.createDataFrame([("A", "s", v) for v in (-5.0, -1.0, 0.0, 3.0, None)],
                                "tenant_id STRING, surface STRING, latency_ms DOUBLE")
    row = dec.latency_summary(log).first()
    assert (row.requests, row.p50, row.p99) == (4, 0.0, 3.0)


def test_rolling_window_edges(spark):
    at = [0 * MINUTE, 4 * MINUTE, 5 * MINUTE, 5 * MINUTE + MICRO, 9 * MINUTE, 9 * MINUTE]
    ev = events(spark, [("A", "c", "click", None, NOW + d) for d in at])
    expected = [(f"e{i}", sum(d - 5 * MINUTE < x <= d for x in at)) for i, d in enumerate(at)]
    assert rows(reports.rolling_5m_features(ev), "id", "last_5m_clicks") == expected


def test_last_5m_and_merge(spark):
    ev = events(spark, [("A", "c", "product_view", "p", NOW), ("A", "c", "click", "p", NOW),
                        ("A", "c", "page_view", None, NOW - 5 * MINUTE + MICRO),
                        ("A", "c", "page_view", None, NOW - 5 * MINUTE),
                        ("A", "c", "click", None, NOW + MICRO)])
    recent = reports.last_5m_features(ev, NOW)
    assert rows(recent, "last_5m_views", "last_5m_clicks", "last_5m_product_views") == [(2, 1, 1)]
    batch = spark.createDataFrame([("A", "c", 1), ("A", "d", 2)],
                                  "tenant_id STRING, customer_id STRING, total INT")
    merged = reports.merge_features(batch, recent).orderBy("customer_id").collect()
    assert merged[0].streaming.last_5m_views == 2 and merged[1].streaming is None


def test_tiers_retention_layers(spark):
    ev = events(spark, [("A", f"c{i}", "click", None, NOW - i * 100 * DAY) for i in range(5)]
                + [("B", "c", "click", None, NOW)])
    assert rows(reports.tenant_tiers(ev, light_max=4), "tenant_id", "tier") == [
        ("A", "heavy"), ("B", "light")]
    assert reports.retained(ev, NOW).count() == 5
    assert reports.storage_layer(ev, NOW, 90).filter("layer = 'hot'").count() == 2


def test_snapshot_rerun_replaces_only_its_day(spark, tmp_path):
    path = str(tmp_path / "snap")
    one = spark.createDataFrame([("a",)], "v STRING")
    two = spark.createDataFrame([("b",)], "v STRING")
    reports.write_snapshot(one, path, NOW - DAY)
    reports.write_snapshot(one, path, NOW)
    reports.write_snapshot(two, path, NOW)
    assert rows(spark.read.parquet(path), "v") == [("a",), ("b",)]


def test_variants_are_stable_and_even(spark):
    people = spark.range(4000).select(
        F.lit("A").alias("tenant_id"), F.concat(F.lit("c"), "id").alias("customer_id"))
    first = ab.assign_variant(people)
    assert rows(first, "customer_id", "variant") == rows(
        ab.assign_variant(people.repartition(7)), "customer_id", "variant")
    share = first.filter("variant = 'A'").count() / 4000
    assert 0.46 < share < 0.54


def test_ab_results(spark):
    people = [("A", f"c{i}") for i in range(20)]
    seen = [(*p, NOW - k * HOUR) for p in people for k in (0, 2)]
    decisions = spark.createDataFrame(
        seen, "tenant_id STRING, customer_id STRING, created_at TIMESTAMP")
    # c1 buys after the first and after the second decision, c2 before any.
    ev = events(spark, [("A", "c1", "purchase", "p", NOW), ("A", "c1", "purchase", "p", NOW - HOUR),
                        ("A", "c2", "purchase", "p", NOW - DAY),
                        ("A", "zz", "purchase", "p", NOW)])
    got = ab.ab_results(decisions, ev)
    total = got.agg(F.sum("customers"), F.sum("exposures"), F.sum("buyers"),
                    F.sum("purchases")).first()
    assert tuple(total) == (20, 40, 1, 2)


def test_integrity_report_finds_each_fault(spark):
    ev = events(spark, [("A", "c", "click", "p", NOW), ("A", None, "jump", "gone", NOW),
                        ("A", "c", "click", "other", NOW - 60 * DAY)])
    ev = ev.unionByName(ev.filter("id = 'e0'"))
    pr = products(spark, [("p", "A", "x"), ("other", "B", "x"), ("p", "C", None)])
    rules = cooc(spark, [("A", "x", "y", 2, 1.5), ("A", "x", "y", 3, 0.5)])
    tenants = spark.createDataFrame([("A", "n", "s"), ("B", "n", "s")],
                                    "id STRING, name STRING, slug STRING")
    report = quality.integrity_report(
        {"tenant": tenants, "product": pr, "interactionevent": ev,
         "product_cooccurrence": rules},
        partitions=[("2026-04-01", "2026-05-01")],
    )
    found = {(r.table_name, r.check_name): r.violations for r in report.collect() if r.violations}
    assert found == {
        ("tenant", "unique:slug"): 1,
        ("product", "unique:id"): 1,
        ("product", "not_null:category"): 1,
        ("product", "foreign:tenant_id"): 1,
        ("interactionevent", "not_null:customer_id"): 1,
        ("interactionevent", "domain:event_type"): 1,
        ("interactionevent", "unique:id,timestamp"): 1,
        ("interactionevent", "foreign:product_id,tenant_id"): 2,
        ("interactionevent", "partition:timestamp"): 1,
        ("product_cooccurrence", "unique:tenant_id,product_a_id,product_b_id"): 1,
        ("product_cooccurrence", "range:co_count"): 1,
        ("product_cooccurrence", "range:confidence"): 1,
    }


def test_popularity_window_and_active(spark):
    ev = events(spark, [("A", "c", "product_view", "p", NOW - 30 * DAY),
                        ("A", "c", "product_view", "p", NOW - 30 * DAY - MICRO),
                        ("A", "c", "purchase", "off", NOW), ("A", "c", "add_to_cart", "p", NOW)])
    pr = products(spark, [("p", "A", "x"), ("off", "A", "x", False)])
    assert rows(cand.popularity(ev, pr, NOW), "product_id", "score", "rank") == [("p", 1.0, 1)]


def test_anchors_latest_five(spark):
    ev = events(spark, [("A", "c", "product_view", f"p{i}", NOW - i * HOUR) for i in range(7)]
                + [("A", "c", "click", "clicked", NOW), ("A", "c", "purchase", "p6", NOW),
                   ("A", "c", "purchase", "old", NOW - 31 * DAY)])
    got = cand.recent_anchors(ev, NOW).orderBy("rank")
    assert [r.product_id for r in got.collect()] == ["p0", "p6", "p1", "p2", "p3"]


def test_latency_mean_of_small_and_huge_values(spark):
    log = spark.createDataFrame(
        [("A", "home", v) for v in (1e-9, 2e-9, 3e-9)] + [("A", "cart", v) for v in (1e30, 3e30)],
        "tenant_id STRING, surface STRING, latency_ms DOUBLE")
    got = {r.surface: r.average for r in dec.latency_summary(log).collect()}
    assert got == {"home": pytest.approx(2e-9), "cart": pytest.approx(2e30)}
