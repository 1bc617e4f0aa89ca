"""Checkpoints, and which customers have events after them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import moment
from basketry.operators.merge import upsert_by_key
from basketry.schemas import CHECKPOINTS, CUSTOMER, FEATURE_JOB, TENANT


def read_checkpoints(checkpoints: DataFrame, job: str = FEATURE_JOB) -> DataFrame:
    """``tenant_id, last_event_ts`` of one job."""
    return checkpoints.filter(F.col("pipeline_name") == job).select("tenant_id", "last_event_ts")


def advance_checkpoints(
    checkpoints: DataFrame, bounds: DataFrame, as_of: str | datetime, job: str = FEATURE_JOB
) -> DataFrame:
    """All checkpoints, with the tenants of ``bounds`` moved to their ``max_ts``."""
    moved = bounds.select(
        "tenant_id",
        F.lit(job).alias("pipeline_name"),
        F.col("max_ts").alias("last_event_ts"),
        moment(as_of).alias("updated_at"),
    )
    return upsert_by_key(checkpoints, moved, ["tenant_id", "pipeline_name"])


def no_checkpoints(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], CHECKPOINTS)


def new_events(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Events strictly later than their tenant's ``last_event_ts``, all without one."""
    return events.join(last_seen, TENANT, "left").filter(
        F.col("last_event_ts").isNull() | (F.col("timestamp") > F.col("last_event_ts"))
    )


def fresh_customers(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Customers with new events: the latest time and the number of these.

    One scan that answers both ``new_event_bounds`` and ``affected_customers``.
    """
    return (
        new_events(events, last_seen)
        .groupBy(*CUSTOMER)
        .agg(F.max("timestamp").alias("max_ts"), F.count("*").alias("new_events"))
    )


def new_event_bounds(events: DataFrame, last_seen: DataFrame) -> DataFrame:
    """Latest time and number of the new events per tenant; quiet tenants have no row."""
    return bounds_of(fresh_customers(events, last_seen))


def bounds_of(fresh: DataFrame) -> DataFrame:
    return fresh.groupBy("tenant_id").agg(
        F.max("max_ts").alias("max_ts"), F.sum("new_events").alias("new_events")
    )


def affected_customers(events: DataFrame, last_seen: DataFrame, bounds: DataFrame) -> DataFrame:
    """Customers with an event after the checkpoint and not after the bound."""
    return (
        new_events(events, last_seen)
        .join(bounds.select("tenant_id", "max_ts"), TENANT)
        .filter(F.col("timestamp") <= F.col("max_ts"))
        .select(*CUSTOMER)
        .distinct()
    )
