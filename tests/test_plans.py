"""What the plans read, and that no join compares every row with every other."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import candidates as cand
from basketry.operators import cooccurrence as co
from basketry.operators import decisions as dec
from basketry.operators import features as feat
from basketry.operators import increments as inc
from basketry.operators import reports, sessions
from basketry.operators.enrich import enrich_events
from basketry.plans import recommend as plan
from basketry.plans.customer_features import customer_features
from basketry.plans.ingest import ingest_to_lake
from basketry.schemas import CHECKPOINTS, RAW_BATCHES
from basketry.sources import lake
from tests.builders import DAY, HOUR, NOW, cooc, events, features, products, requests, rows


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "lake")
    lake.write_events(events(spark, [
        ("A", f"c{i % 5}", ("purchase", "product_view")[i % 2], f"p{i % 3}", NOW - i * HOUR)
        for i in range(40)]), path)
    return lake.read_events(spark, path)


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def jobs(spark, ev):
    pr = products(spark, [(f"p{i}", "A", "x") for i in range(3)])
    seen = inc.read_checkpoints(
        spark.createDataFrame([("A", "customer_features_v1", NOW - DAY, NOW)], CHECKPOINTS))
    rq = requests(spark, [("A", "c1", 3, ["p1"])])
    fe = features(spark, [("A", "c1", {"x": 2.0})])
    ru = cooc(spark, [("A", "p0", "p1", 3, 0.5)])
    return {
        "enrich": lambda: enrich_events(ev, pr),
        "features": lambda: customer_features(ev, pr, NOW),
        "sessionize": lambda: sessions.sessionize(ev),
        "pairs": lambda: co.candidate_pairs(ev, wide=1, chunk=1),
        "rules": lambda: co.cooccurrence(ev, NOW, wide=1, chunk=1),
        "bounds": lambda: inc.new_event_bounds(ev, seen),
        "popularity": lambda: cand.popularity(ev, pr, NOW),
        "affinity": lambda: cand.affinity_candidates(fe, pr),
        "recommend": lambda: plan.recommend(rq, ev, pr, fe, ru, NOW),
        "latency": lambda: dec.latency_summary(
            ev.withColumn("surface", F.lit("s")).withColumn("latency_ms", F.rand(1))),
    }


@pytest.mark.parametrize("name", ["enrich", "features", "sessionize", "pairs", "rules", "bounds",
                                  "popularity", "affinity", "recommend", "latency"])
def test_joins_are_keyed(spark, stored, no_broadcast, name):
    text = physical(jobs(spark, stored)[name]())
    assert "CartesianProduct" not in text
    assert "NestedLoopJoin" not in text
    assert "PythonUDF" not in text and "InPandas" not in text


def test_filters_reach_the_scan(spark, stored):
    text = physical(co.purchase_slots(stored))
    assert "EqualTo(event_type,purchase)" in text and "IsNotNull(product_id)" in text
    assert "properties" not in text.split("ReadSchema")[1]
    text = physical(cand.recent_anchors(stored, NOW))
    assert "GreaterThanOrEqual(timestamp" in text and "In(event_type" in text


def test_only_needed_columns_are_read(spark, stored):
    schema = physical(reports.daily_activity(stored)).split("ReadSchema")[1]
    assert "customer_id" not in schema and "properties" not in schema


def test_tops_are_cut_before_the_shuffle(spark, stored):
    for job in (cand.recent_anchors(stored, NOW),
                cand.popularity(stored, products(spark, [("p0", "A", "x")]), NOW),
                co.related_products(cooc(spark, [("A", "p0", "p1", 3, 0.5)]), 2)):
        assert "WindowGroupLimit" in physical(job)


@pytest.mark.parametrize("job", [
    lambda ev: feat.activity_counts(ev),
    lambda ev: sessions.slot_rows(ev, "30 minutes"),
    lambda ev: co.purchase_slots(ev),
    lambda ev: feat.product_touches(ev, NOW),
])
def test_rows_are_folded_before_the_shuffle(stored, job):
    text = physical(job(stored))
    below = text.split("Exchange hashpartitioning")[1]
    assert "partial_" in below


def test_ingest_to_lake(spark, tmp_path):
    good = '{"events": [{"customer_id": "c", "event_type": "click", "timestamp": 1762078500}]}'
    raw = spark.createDataFrame([("b0", "A", good), ("b1", "A", "{}")], RAW_BATCHES)
    paths = str(tmp_path / "lake"), str(tmp_path / "rejected")
    for _ in range(2):  # a replay adds nothing
        ingest_to_lake(raw, *paths, uuid_ids=False)
    assert lake.read_events(spark, paths[0]).count() == 1
    assert rows(spark.read.parquet(paths[1]), "batch_id", "reason") == [("b1", "events missing")]
