import pytest

from basketry import schemas
from basketry.operators import increments as inc
from basketry.operators.merge import upsert_by_key
from basketry.plans.customer_features import customer_features
from basketry.plans.incremental import incremental_features, run_incremental
from basketry.plans.refresh_cooccurrence import refresh_cooccurrence
from basketry.schemas import COOCCURRENCE
from basketry.sources import tables
from tests.builders import DAY, HOUR, NOW, events, products, rows

COUNTS = ["tenant_id", "customer_id", "total_views", "total_purchases"]


def history():
    return [("A", f"c{i % 4}", "purchase" if i % 3 else "page_view", "p", NOW - i * DAY)
            for i in range(12)] + [("B", "c1", "page_view", None, NOW - 2 * DAY)]


def held(spark, *marks):
    return spark.createDataFrame(
        [(t, schemas.FEATURE_JOB, at, at) for t, at in marks], schemas.CHECKPOINTS)


def empty(spark):
    return spark.createDataFrame([], schemas.CUSTOMER_FEATURES)


def test_bounds_are_strictly_after_the_checkpoint(spark):
    ev = events(spark, history())
    seen = inc.read_checkpoints(held(spark, ("A", NOW - DAY), ("B", NOW - 2 * DAY)))
    got = inc.new_event_bounds(ev, seen)
    assert rows(got, "tenant_id", "new_events") == [("A", 1)]
    assert rows(inc.affected_customers(ev, seen, got), "customer_id") == [("c0",)]


def test_first_run_equals_the_full_job(spark):
    ev, pr = events(spark, history()), products(spark, [("p", "A", "x")])
    result = incremental_features(ev, pr, empty(spark), held(spark), NOW)
    full = customer_features(ev, pr, NOW)
    plain = [c for c in full.columns if c not in ("category_affinity", "updated_at")]
    assert rows(result.features, *plain) == rows(full, *plain)
    assert rows(result.report, "tenant_id", "affected_customers", "upserted_rows",
                "processed_events") == [("A", 4, 4, 12), ("B", 1, 1, 1)]
    assert rows(result.checkpoints, "tenant_id", "last_event_ts") == [
        ("A", NOW.replace(tzinfo=None)), ("B", (NOW - 2 * DAY).replace(tzinfo=None))]


def test_only_affected_customers_change(spark):
    ev, pr = events(spark, history()), products(spark, [])
    stored = spark.createDataFrame(
        [("A", "c0", 99, 99), ("A", "c1", 99, 99)],
        "tenant_id STRING, customer_id STRING, total_views INT, total_purchases INT")
    stored = empty(spark).unionByName(stored, allowMissingColumns=True)
    result = incremental_features(ev, pr, stored, held(spark, ("A", NOW - HOUR), ("B", NOW)), NOW)
    assert rows(result.features, *COUNTS) == [("A", "c0", 1, 2), ("A", "c1", 99, 99)]


def test_late_event_is_not_noticed(spark):
    ev = events(spark, [("A", "late", "click", None, NOW - DAY)])
    seen = inc.read_checkpoints(held(spark, ("A", NOW - DAY)))
    assert inc.new_event_bounds(ev, seen).count() == 0


def test_stored_runs(spark, tmp_path):
    """First run, a repeat without news, then one new event."""
    pr = products(spark, [("p", "A", "x")])
    roots = str(tmp_path / "features"), str(tmp_path / "marks")
    ev = events(spark, history())
    first = run_incremental(spark, ev, pr, *roots, NOW)
    assert sum(r.processed_events for r in first.collect()) == 13
    second = run_incremental(spark, ev, pr, *roots, NOW)
    assert sum(r.processed_events for r in second.collect()) == 0
    assert tables._versions(spark, roots[0]) == [1]
    more = events(spark, history() + [("A", "c9", "page_view", None, NOW + HOUR)])
    third = run_incremental(spark, more, pr, *roots, NOW)
    assert rows(third, "tenant_id", "affected_customers") == [("A", 1), ("B", 0)]
    now = tables.current(spark, roots[0], schemas.CUSTOMER_FEATURES)
    assert now.count() == 6 and now.filter("customer_id = 'c9'").count() == 1


def test_checkpoints_of_other_jobs_stay(spark):
    marks = held(spark, ("A", NOW)).unionByName(
        spark.createDataFrame([("A", "other", NOW, NOW)], schemas.CHECKPOINTS))
    bounds = spark.createDataFrame([("A", NOW + DAY, 1)],
                                   "tenant_id STRING, max_ts TIMESTAMP, new_events BIGINT")
    got = inc.advance_checkpoints(marks, bounds, NOW)
    assert rows(got, "pipeline_name", "last_event_ts") == [
        (schemas.FEATURE_JOB, (NOW + DAY).replace(tzinfo=None)),
        ("other", NOW.replace(tzinfo=None))]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "k STRING, v INT")
    new = spark.createDataFrame([("B", 3), ("C", 4)], "k STRING, v INT")
    once = upsert_by_key(old, new, ["k"])
    assert rows(once, "k", "v") == [("A", 1), ("B", 3), ("C", 4)]
    assert rows(upsert_by_key(once, new, ["k"]), "k", "v") == rows(once, "k", "v")


def test_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.publish(spark.createDataFrame([(1,)], "v INT"), root)
    (tmp_path / "t" / "v=2").mkdir()
    assert rows(tables.current(spark, root, "v INT"), "v") == [(1,)]
    assert tables.upsert_table(spark.createDataFrame([(2,)], "v INT"), root, ["v"], "v INT") == 3


def test_merge_needs_a_table_format_with_merge(spark):
    spark.createDataFrame([("A", 1)], "k STRING, v INT").write.saveAsTable("plain_table")
    with pytest.raises(Exception, match="MERGE"):
        tables.merge_table(spark.createDataFrame([("A", 2)], "k STRING, v INT"),
                           "plain_table", ["k"])


def test_refresh_replaces_and_clears(spark, tmp_path):
    def buys(tenant, first="p"):
        return [(tenant, c, "purchase", p, NOW + i * HOUR)
                for c in "xyz" for i, p in enumerate((first, "q"))]

    def named(*tenants):
        return spark.createDataFrame([(t,) for t in tenants], "tenant_id STRING")

    path = str(tmp_path / "pairs")
    both = events(spark, buys("A/1") + buys("B") + buys("C"))
    assert refresh_cooccurrence(both, named("A/1", "B", "C"), path, NOW).count() == 0
    # A/1 has a click left, C no event at all; B is not refreshed, though its events are given.
    left = events(spark, [("A/1", "x", "click", "p", NOW)] + buys("B") + buys("B", "r"))
    emptied = refresh_cooccurrence(left, named("A/1", "C"), path, NOW)
    assert rows(emptied, "tenant_id") == [("A/1",), ("C",)]
    stored = tables.current(spark, path, COOCCURRENCE)
    assert rows(stored, "tenant_id", "product_a_id", "co_count") == [("B", "p", 3)]
    assert tables.prune_versions(spark, path, keep=1) == [1]
    assert stored.count() == 1
