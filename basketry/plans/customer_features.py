"""The full feature row per customer."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import is_type, moment, parsed_revenue
from basketry.operators import features as f
from basketry.operators import sessions as s
from basketry.schemas import CUSTOMER


def folded_slots(events: DataFrame, on_bad: str = "fail") -> DataFrame:
    """One row per customer and session slot with all that the features need of its events.

    Rows of one slot from several sets of events merge by their sums, minima and maxima.
    """
    us = F.unix_micros("timestamp")
    bought = is_type("purchase")
    amount = F.col("amount")
    # Every event's amount is looked at, so a malformed one fails on any event type.
    sold = F.when(amount.isNotNull() & bought, amount)
    priced = events.select(
        *CUSTOMER, "event_type", "product_id", "timestamp",
        parsed_revenue(F.col("properties"), on_bad).alias("amount"),
    )
    return s.slot_rows(
        priced,
        s.GAP,
        *f.count_measures(),
        F.min(F.when(bought, us)).alias("first_buy_us"),
        F.max(F.when(bought, us)).alias("last_buy_us"),
        F.sum(sold).alias("revenue"),
        F.sum(F.when(sold > 0, sold)).alias("paid_total"),
        F.count_if(sold > 0).alias("paid_n"),
    )


def customer_features(
    events: DataFrame,
    products: DataFrame,
    as_of: str | datetime,
    customers: DataFrame | None = None,
    on_bad: str = "fail",
) -> DataFrame:
    """Counts, recency, affinity, purchase, revenue and session measures per customer.

    Two branches read the events once each. The first folds them to customer time slots,
    the second to customer products; everything after works on those rows. ``customers``
    restricts the result to the given keys. It is applied to the folded rows, so raw
    events are never shuffled for it.
    """
    slots, touches = folded_slots(events, on_bad), f.product_touches(events, as_of)
    if customers is not None:
        keys = customers.select(*CUSTOMER).distinct()
        slots = slots.join(keys, CUSTOMER, "left_semi")
        touches = touches.join(keys, CUSTOMER, "left_semi")
    return finished_features(slots, touches, products, as_of)


def finished_features(
    slots: DataFrame, touches: DataFrame, products: DataFrame, as_of: str | datetime
) -> DataFrame:
    """The feature rows, from one row per customer and slot and one per customer and product."""
    measures = [
        F.sum(name).alias(name)
        for name in ("total_views", "total_cart_adds", "total_purchases", "revenue",
                     "paid_total", "paid_n")
    ]
    base = (
        s.mark_sessions(slots, s.GAP)
        .groupBy(*CUSTOMER)
        .agg(
            *measures,
            *s.session_measures(),
            F.min("start_us").alias("first_us"),
            F.max("end_us").alias("last_us"),
            F.min("first_buy_us").alias("first_buy_us"),
            F.max("last_buy_us").alias("last_buy_us"),
        )
    )
    by_product = f.product_features(touches, products)
    no_scores = F.create_map().cast("map<string,double>")
    gaps = f.mean_gap_days(F.col("first_buy_us"), F.col("last_buy_us"), F.col("total_purchases"))
    return base.join(by_product, CUSTOMER, "left").select(
        *CUSTOMER,
        *[
            F.coalesce(name, F.lit(0)).cast("int").alias(name)
            for name in ("total_views", "total_cart_adds", "total_purchases",
                         "distinct_products_viewed", "distinct_categories_viewed")
        ],
        f.days_since(F.timestamp_micros("first_us"), as_of).alias("days_since_first_seen"),
        f.days_since(F.timestamp_micros("last_us"), as_of).alias("days_since_last_activity"),
        F.coalesce("category_affinity", no_scores).alias("category_affinity"),
        gaps.alias("avg_days_between_purchases"),
        F.coalesce("revenue", F.lit(0)).cast(f.MONEY).alias("total_revenue"),
        f.mean_order(F.col("paid_total"), F.col("paid_n")).alias("avg_order_value"),
        s.mean_session_seconds().alias("avg_session_duration_seconds"),
        s.mean_session_products().alias("avg_products_viewed_per_session"),
        moment(as_of).alias("updated_at"),
    )
