"""Sessions: a new one starts at a customer's first event and after a gap over 30 minutes.

Events in one time slot as wide as the gap always share a session, since they lie less
than the gap apart. So events are first folded to one row per customer and slot, and only
these rows, whose number is bounded by time and not by traffic, pass through the
per-customer window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expressions import micros_of, time_slot
from basketry.schemas import CUSTOMER

GAP = "30 minutes"


def slot_rows(events: DataFrame, gap: str, *measures: Column) -> DataFrame:
    """One row per customer and slot: first and last event, product events, ``measures``."""
    us = F.unix_micros("timestamp")
    return events.groupBy(*CUSTOMER, time_slot(us, micros_of(gap)).alias("slot")).agg(
        F.min(us).alias("start_us"),
        F.max(us).alias("end_us"),
        F.count("product_id").alias("product_events"),
        *measures,
    )


def mark_sessions(slots: DataFrame, gap: str) -> DataFrame:
    """Slot rows with ``idle_us`` since the previous slot and ``starts`` for a new session."""
    by_time = Window.partitionBy(*CUSTOMER).orderBy("slot")
    return slots.withColumn(
        "idle_us", F.col("start_us") - F.lag("end_us").over(by_time)
    ).withColumn(
        "starts",
        F.when(F.col("idle_us").isNull() | (F.col("idle_us") > micros_of(gap)), 1).otherwise(0),
    )


def session_measures() -> list[Column]:
    """Sums over marked slots: the time in sessions is the span less the breaks."""
    return [
        F.sum("starts").alias("sessions"),
        (
            F.max("end_us")
            - F.min("start_us")
            - F.coalesce(F.sum(F.when(F.col("starts") == 1, F.col("idle_us"))), F.lit(0))
        ).alias("session_us"),
        F.sum("product_events").alias("session_products"),
    ]


def mean_session_seconds() -> Column:
    return F.col("session_us") / F.col("sessions") / F.lit(1_000_000.0)


def mean_session_products() -> Column:
    return F.col("session_products") / F.col("sessions")


def session_stats(events: DataFrame, gap: str = GAP) -> DataFrame:
    """Mean session length in seconds and mean product events per session."""
    marked = mark_sessions(slot_rows(events, gap), gap)
    return (
        marked.groupBy(*CUSTOMER)
        .agg(*session_measures())
        .select(
            *CUSTOMER,
            mean_session_seconds().alias("avg_session_duration_seconds"),
            mean_session_products().alias("avg_products_viewed_per_session"),
        )
    )


def sessionize(events: DataFrame, gap: str = GAP) -> DataFrame:
    """Every event with its customer's running ``session_num``, counted from 1.

    Session numbers are found per slot and joined back by slot, so the events of a busy
    customer stay spread over tasks.
    """
    running = (
        Window.partitionBy(*CUSTOMER)
        .orderBy("slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    numbered = mark_sessions(slot_rows(events, gap), gap).select(
        *CUSTOMER, "slot", F.sum("starts").over(running).alias("session_num")
    )
    slot = time_slot(F.unix_micros("timestamp"), micros_of(gap))
    return events.withColumn("slot", slot).join(numbered, [*CUSTOMER, "slot"]).drop("slot")


def session_windows(events: DataFrame, gap: str = GAP) -> DataFrame:
    """Start, end and size of each session, for reports."""
    return (
        mark_sessions(slot_rows(events, gap, F.count("*").alias("events")), gap)
        .withColumn(
            "session_num",
            F.sum("starts").over(
                Window.partitionBy(*CUSTOMER)
                .orderBy("slot")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .groupBy(*CUSTOMER, "session_num")
        .agg(
            F.timestamp_micros(F.min("start_us")).alias("session_start"),
            F.timestamp_micros(F.max("end_us")).alias("session_end"),
            F.sum("events").alias("events"),
            F.sum("product_events").alias("product_events"),
        )
    )
