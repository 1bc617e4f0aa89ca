"""Daily jobs on bucketed tables: the same rows, without a shuffle by customer."""

import pytest

from basketry.plans import feature_state as state
from basketry.plans.customer_features import customer_features
from basketry.schemas import CUSTOMER
from basketry.sources import bucketed
from tests.builders import events
from tests.test_feature_state import MIDNIGHT, catalogue, flat, history


@pytest.fixture()
def tables(spark, tmp_path):
    # A stored catalogue has a known size, so that Spark may broadcast it.
    catalogue(spark).write.parquet(str(tmp_path / "products"))
    ev, pr = events(spark, history()), spark.read.parquet(str(tmp_path / "products"))
    held = bucketed.write_bucketed(state.folded(ev), "bucketed_state", str(tmp_path / "state"), 4, sort_by=["slot"])
    features = bucketed.write_bucketed(customer_features(ev, pr, MIDNIGHT), "bucketed_features", str(tmp_path / "features"), 4)
    yield held, features, ev, pr
    for name in ("bucketed_state", "bucketed_features"):
        bucketed.drop_bucketed(spark, name)


def test_features_without_a_shuffle_by_customer(spark, tables):
    held, _, ev, pr = tables
    got = state.features_of(held, pr, MIDNIGHT)
    assert not bucketed.shuffled_by(got, "customer_id")
    assert bucketed.shuffled_by(state.features_of(state.folded(ev), pr, MIDNIGHT), "customer_id")
    assert flat(got) == flat(customer_features(ev, pr, MIDNIGHT))


def test_joins_of_two_tables(spark, tables):
    held, features, *_ = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = held.groupBy(*CUSTOMER).count().join(features, CUSTOMER)
        assert not bucketed.shuffled_by(joined, "customer_id")
        assert joined.count() == features.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_file_for_each_bucket(spark, tables, tmp_path):
    assert 1 <= len(list((tmp_path / "state").glob("*.parquet"))) <= 4
