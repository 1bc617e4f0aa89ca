"""Recompute the features of customers with new events and move the checkpoints."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import increments as inc
from basketry.operators.merge import upsert_by_key
from basketry.plans.customer_features import customer_features
from basketry.schemas import CHECKPOINTS, CUSTOMER, CUSTOMER_FEATURES, FEATURE_JOB
from basketry.session import materialize
from basketry.sources import tables


@dataclass
class IncrementalFeatures:
    """Tables after the run and one report row per tenant with events or a checkpoint."""

    updates: DataFrame
    features: DataFrame
    checkpoints: DataFrame
    report: DataFrame


def incremental_features(
    events: DataFrame,
    products: DataFrame,
    features: DataFrame,
    checkpoints: DataFrame,
    as_of: str | datetime,
    job: str = FEATURE_JOB,
    recent: DataFrame | None = None,
    on_bad: str = "fail",
) -> IncrementalFeatures:
    """Full history of the affected customers, the stored row for everyone else.

    New events are looked for in ``recent``, by default in all ``events``. A caller who
    knows no tenant's checkpoint is older than some day passes the lake from that day, so
    the search reads only those folders.

    A late event not after the checkpoint is noticed only once its customer has a newer
    one. Events must not change during the run, so every new event is within the bound.
    Without new events nothing changes. ``on_bad="null"`` counts a purchase whose revenue is
    no number as unpaid, so that one bad value does not stop the other tenants.
    """
    last_seen = inc.read_checkpoints(checkpoints, job)
    searched = events if recent is None else recent
    affected = materialize(inc.fresh_customers(searched, last_seen), "fresh")
    bounds = materialize(inc.bounds_of(affected), "bounds")
    updates = customer_features(events, products, as_of, affected, on_bad=on_bad)
    updates = (
        updates.drop("updated_at")
        .join(bounds.select("tenant_id", F.col("max_ts").alias("updated_at")), "tenant_id")
        .select(*features.columns)
    )
    updates = materialize(updates, "updates")
    known = last_seen.join(bounds, "tenant_id", "full")
    sizes = updates.groupBy("tenant_id").agg(F.count("*").alias("upserted_rows"))
    asked = affected.groupBy("tenant_id").agg(F.count("*").alias("affected_customers"))
    report = (
        known.join(asked, "tenant_id", "left")
        .join(sizes, "tenant_id", "left")
        .select(
            "tenant_id",
            F.col("last_event_ts").alias("checkpoint_before"),
            F.coalesce("max_ts", "last_event_ts").alias("checkpoint_after"),
            F.coalesce("affected_customers", F.lit(0)).alias("affected_customers"),
            F.coalesce("upserted_rows", F.lit(0)).alias("upserted_rows"),
            F.coalesce("new_events", F.lit(0)).alias("processed_events"),
        )
    )
    return IncrementalFeatures(
        updates=updates,
        features=upsert_by_key(features, updates, CUSTOMER),
        checkpoints=inc.advance_checkpoints(checkpoints, bounds, as_of, job),
        report=report,
    )


def run_incremental(
    spark: SparkSession,
    events: DataFrame,
    products: DataFrame,
    features_root: str,
    checkpoints_root: str,
    as_of: str | datetime,
    recent: DataFrame | None = None,
    on_bad: str = "fail",
) -> DataFrame:
    """One run on stored tables: features first, then checkpoints; returns the report.

    Only the cells of the feature table that hold an affected customer are rewritten. A crash
    between the two writes only makes the next run recompute the same customers.
    """
    result = incremental_features(
        events,
        products,
        tables.current(spark, features_root, CUSTOMER_FEATURES),
        tables.current(spark, checkpoints_root, CHECKPOINTS),
        as_of,
        recent=recent,
        on_bad=on_bad,
    )
    report = materialize(result.report, "report")
    if report.filter(F.col("processed_events") > 0).isEmpty():
        return report
    tables.upsert_table(result.updates, features_root, CUSTOMER, CUSTOMER_FEATURES, ["tenant_id"])
    tables.publish(result.checkpoints, checkpoints_root)
    return report
