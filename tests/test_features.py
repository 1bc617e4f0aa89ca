from datetime import datetime, timezone
from decimal import Decimal

import pytest

from basketry.functions.expressions import moment
from basketry.operators import features as feat
from basketry.operators import sessions
from basketry.operators.enrich import enrich_events
from basketry.plans.customer_features import customer_features
from tests.builders import DAY, MICRO, MINUTE, NOW, events, products, rows

T0 = datetime(2026, 4, 1, tzinfo=timezone.utc)


def one(df):
    (row,) = df.collect()
    return row


def test_session_boundary(spark):
    ev = events(spark, [("A", "c", "click", None, T0 + d)
                        for d in (0 * MINUTE, 30 * MINUTE, 60 * MINUTE + MICRO)])
    assert rows(sessions.sessionize(ev), "id", "session_num") == [("e0", 1), ("e1", 1), ("e2", 2)]
    assert one(sessions.session_stats(ev)).avg_session_duration_seconds == 900.0


def test_single_event_session(spark):
    ev = events(spark, [("A", "c", "click", "p", T0)])
    row = one(sessions.session_stats(ev))
    assert (row.avg_session_duration_seconds, row.avg_products_viewed_per_session) == (0.0, 1.0)


def test_sessions_equal_the_lag_definition(spark):
    """Gaps around the limit, ties and slot edges, against lag over single events."""
    step = [0, 1, 29, 30, 31, 0, 7, 30, 30, 59, 3, 30, 1, 31]
    history, at = [], 0
    for i, minutes in enumerate(step * 3):
        at += minutes
        history.append(("A", "c", "click", "p" if i % 2 else None,
                        T0 + at * MINUTE + (i % 3) * MICRO))
    ev = events(spark, history)
    ev.createOrReplaceTempView("ev_sessions")
    lagged = spark.sql("""
        SELECT id, sum(starts) OVER (ORDER BY timestamp, id) AS session_num FROM (
          SELECT id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (ORDER BY timestamp, id)
              <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS starts FROM ev_sessions)""")
    assert rows(sessions.sessionize(ev), "id", "session_num") == rows(lagged, "id", "session_num")


def test_purchase_gaps(spark):
    ev = events(spark, [("A", "c", "purchase", "p", T0 + d * DAY) for d in (0, 2, 6)]
                + [("A", "once", "purchase", "p", T0)])
    assert rows(feat.purchase_gaps(ev), "customer_id", "avg_days_between_purchases") == [
        ("c", 3.0), ("once", None)]


def test_order_value(spark):
    texts = ['{"revenue": 10}', '{"revenue": 0}', "{}", '{"revenue": "20"}']
    ev = events(spark, [("A", "c", "purchase", "p", T0, t) for t in texts])
    row = one(feat.purchase_revenue(ev))
    assert (row.total_revenue, row.avg_order_value) == (Decimal("30.00"), Decimal("15.00"))


def test_escaped_revenue_key(spark):
    ev = events(spark, [("A", "c", "purchase", "p", T0, '{"\\u0072evenue": 5}')])
    assert one(feat.purchase_revenue(ev)).total_revenue == Decimal("5.00")


def test_malformed_revenue(spark):
    ev = events(spark, [("A", "c", "click", "p", T0, '{"revenue": "abc"}')])
    pr = products(spark, [("p", "A", "x")])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        customer_features(ev, pr, NOW).collect()
    assert one(customer_features(ev, pr, NOW, on_bad="null")).total_revenue == Decimal("0.00")


def test_affinity_tiers_and_stale_category(spark):
    ev = events(spark, [("A", "c", "product_view", "p", NOW - n * DAY) for n in (7, 30, 31)]
                + [("A", "c", "purchase", "q", NOW - 40 * DAY),
                   ("A", "c", "click", "r", NOW)])
    pr = products(spark, [("p", "A", "fresh"), ("q", "A", "stale"), ("r", "A", "clicked")])
    expected = [("fresh", 4.0), ("stale", 0.0)]
    got = feat.category_affinity_rows(ev, pr, NOW)
    assert rows(got, "category", "affinity_score") == expected
    row = one(customer_features(ev, pr, NOW))
    assert row.category_affinity == dict(expected)
    assert row.distinct_categories_viewed == 3


def test_foreign_product_counts_without_category(spark):
    ev = events(spark, [("A", "c", "product_view", "p", NOW)])
    pr = products(spark, [("p", "B", "x")])
    row = one(customer_features(ev, pr, NOW))
    assert (row.distinct_products_viewed, row.distinct_categories_viewed) == (1, 0)
    assert row.category_affinity == {}


def test_feature_row(spark):
    ev = events(spark, [
        ("A", "c", "page_view", None, NOW - 20 * DAY),
        ("A", "c", "product_view", "p", NOW - 20 * DAY + 10 * MINUTE),
        ("A", "c", "add_to_cart", "p", NOW - 5 * DAY),
        ("A", "c", "purchase", "p", NOW - 5 * DAY + MINUTE, '{"revenue": 12.345}'),
        ("A", "c", "purchase", "q", NOW - 3 * DAY + MINUTE, '{"revenue": 7}'),
        ("B", "c", "purchase", "p", NOW, '{"revenue": 1000}'),
    ])
    pr = products(spark, [("p", "A", "x"), ("q", "A", "y"), ("p", "B", "z")])
    row = one(customer_features(ev, pr, NOW).filter("tenant_id = 'A'")).asDict()
    assert row == {
        "tenant_id": "A", "customer_id": "c", "total_views": 2, "total_cart_adds": 1,
        "total_purchases": 2, "distinct_products_viewed": 2, "distinct_categories_viewed": 2,
        "days_since_first_seen": 20, "days_since_last_activity": 3,
        "category_affinity": {"x": 7.0, "y": 3.0}, "avg_days_between_purchases": 2.0,
        "total_revenue": Decimal("19.35"), "avg_order_value": Decimal("9.67"),
        "avg_session_duration_seconds": 220.0,
        "avg_products_viewed_per_session": 4 / 3, "updated_at": NOW.replace(tzinfo=None),
    }


def test_basic_features_are_part_of_the_full_row(spark):
    ev = events(spark, [("A", f"c{i % 3}", t, p, NOW - i * DAY)
                        for i, (t, p) in enumerate([("page_view", None), ("purchase", "p"),
                                                    ("add_to_cart", "q"), ("click", "gone")] * 4)])
    pr = products(spark, [("p", "A", "x"), ("q", "A", "y")])
    basic = feat.basic_features(ev, pr, NOW)
    assert rows(basic, *basic.columns) == rows(customer_features(ev, pr, NOW), *basic.columns)


def test_restricted_to_customers(spark):
    ev = events(spark, [("A", "c", "click", "p", NOW), ("A", "d", "click", "p", NOW),
                        ("B", "c", "click", "p", NOW)])
    pr = products(spark, [("p", "A", "x")])
    chosen = spark.createDataFrame([("A", "c")], "tenant_id STRING, customer_id STRING")
    got = customer_features(ev, pr, NOW, customers=chosen)
    assert rows(got, "tenant_id", "customer_id") == [("A", "c")]


def test_moment_reads_naive_values_as_utc(spark):
    row = spark.range(1).select(
        moment("2026-01-01 00:00:00").alias("a"),
        moment("2026-01-01T02:00:00+02:00").alias("b"),
        moment(datetime(2026, 1, 1)).alias("c"),
    ).collect()[0]
    assert row.a == row.b == row.c


def test_hot_customer_reaches_the_window_folded(spark):
    """A third of all rows in one customer: per-slot rows, not events, meet the window."""
    hot = [("A", "hot", "click", "p", T0 + i * MINUTE / 10) for i in range(3000)]
    ev = events(spark, hot + [("A", f"c{i}", "click", "p", T0) for i in range(50)])
    slots = sessions.slot_rows(ev, sessions.GAP)
    assert slots.filter("customer_id = 'hot'").count() == 10
    assert rows(sessions.session_windows(ev).filter("customer_id = 'hot'"),
                "session_num", "events") == [(1, 3000)]
