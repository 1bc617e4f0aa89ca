"""Daily activity, tenant tiers, retention, snapshots and merged features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.expressions import before, is_type, is_view, micros_of, moment, time_slot
from basketry.schemas import CUSTOMER

LIGHT_TENANT = 10_000


def day_measures() -> list[Column]:
    return [
        F.count_if(is_view()).alias("views"),
        F.count_if(is_type("purchase")).alias("purchases"),
        F.count_if(is_type("add_to_cart")).alias("cart_adds"),
    ]


def daily_activity(events: DataFrame) -> DataFrame:
    """Views, purchases and cart adds per tenant and UTC day."""
    return events.groupBy("tenant_id", F.to_date("timestamp").alias("day")).agg(*day_measures())


def minute_measures(prefix: str = "last_5m") -> list[Column]:
    return [
        F.count_if(is_view()).alias(f"{prefix}_views"),
        F.count_if(is_type("click")).alias(f"{prefix}_clicks"),
        F.count_if(is_type("product_view")).alias(f"{prefix}_product_views"),
    ]


def last_5m_features(events: DataFrame, as_of: str | datetime) -> DataFrame:
    """Views, clicks and product views per customer in the five minutes up to ``as_of``."""
    recent = (F.col("timestamp") > before(as_of, "5 minutes")) & (
        F.col("timestamp") <= moment(as_of)
    )
    return events.filter(recent).groupBy(*CUSTOMER).agg(*minute_measures())


def sliding_5m_features(events: DataFrame) -> DataFrame:
    """The same counts for every five-minute window that starts on a minute."""
    return (
        events.groupBy(*CUSTOMER, F.window("timestamp", "5 minutes", "1 minute").alias("w"))
        .agg(*minute_measures())
        .select(
            *CUSTOMER,
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "last_5m_views",
            "last_5m_clicks",
            "last_5m_product_views",
        )
    )


def latest_5m_features(sliding: DataFrame) -> DataFrame:
    """Each customer's newest window of ``sliding_5m_features``."""
    values = [c for c in sliding.columns if c not in CUSTOMER]
    newest = F.max_by(F.struct(*values), "window_start").alias("row")
    return sliding.groupBy(*CUSTOMER).agg(newest).select(*CUSTOMER, "row.*")


def rolling_5m_features(events: DataFrame) -> DataFrame:
    """For every event, the counts of its customer's five minutes ending with it.

    Each event adds one to its own five-minute slot and to the next, and takes it away
    when five minutes are over, so a running total gives the count and the work is linear.
    A window partition is one customer's ten minutes, not the whole customer. Only the
    events themselves are returned.
    """
    width = micros_of("5 minutes")
    us = F.unix_micros("timestamp")
    placed = events.select(
        *CUSTOMER,
        "id",
        "timestamp",
        "event_type",
        F.explode(
            F.array(
                *[
                    F.struct(
                        (time_slot(us, width) + later).alias("slot"),
                        (us + over).alias("us"),
                        F.lit(step).alias("step"),
                        F.lit(not later).alias("own"),
                    )
                    for later, over, step in ((0, 0, 1), (1, 0, 1), (1, width, -1))
                ]
            )
        ).alias("at"),
    )
    so_far = (
        Window.partitionBy(*CUSTOMER, "at.slot").orderBy("at.us")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def alive(test: Column) -> Column:
        return F.sum(F.when(test, F.col("at.step")).otherwise(0)).over(so_far)

    return (
        placed.select(
            *CUSTOMER,
            "id",
            "timestamp",
            "at.own",
            alive(is_view()).alias("last_5m_views"),
            alive(is_type("click")).alias("last_5m_clicks"),
            alive(is_type("product_view")).alias("last_5m_product_views"),
        )
        .filter("own")
        .drop("own")
    )


def merge_features(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """Batch features with the customer's stream features nested under ``streaming``."""
    nested = stream.select(
        *CUSTOMER, F.struct(*[c for c in stream.columns if c not in CUSTOMER]).alias("streaming")
    )
    return batch.join(nested, CUSTOMER, "left")


def tenant_tiers(events: DataFrame, light_max: int = LIGHT_TENANT) -> DataFrame:
    """Customers per tenant, ``light`` up to ``light_max`` and ``heavy`` beyond."""
    return (
        events.select(*CUSTOMER)
        .distinct()
        .groupBy("tenant_id")
        .agg(F.count("*").alias("customers"))
        .withColumn("tier", F.when(F.col("customers") <= light_max, "light").otherwise("heavy"))
    )


def retained(events: DataFrame, as_of: str | datetime, days: int = 365) -> DataFrame:
    """Events of the last ``days`` days."""
    return events.filter(F.col("timestamp") >= before(as_of, f"{days} days"))


def storage_layer(events: DataFrame, as_of: str | datetime, hot_days: int = 90) -> DataFrame:
    """Events with ``layer``: ``hot`` within ``hot_days``, else ``cold``."""
    hot = F.col("timestamp") >= before(as_of, f"{hot_days} days")
    return events.withColumn("layer", F.when(hot, "hot").otherwise("cold"))


def with_snapshot_date(table: DataFrame, as_of: str | datetime) -> DataFrame:
    return table.withColumn("snapshot_date", F.to_date(moment(as_of)))


def write_snapshot(table: DataFrame, path: str, as_of: str | datetime) -> None:
    """Write the day's snapshot; a repeated run replaces that day only."""
    (
        with_snapshot_date(table, as_of)
        .hint("rebalance")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, day: str | datetime) -> DataFrame:
    """The snapshot of one day; only its folder is read."""
    return spark.read.parquet(path).filter(F.col("snapshot_date") == F.to_date(moment(day)))
