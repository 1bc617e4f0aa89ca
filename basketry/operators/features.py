"""Per-customer measures.

Each measure is a sum, minimum or maximum that Spark combines before it shuffles, so a
customer or product with a large part of all events costs a task one row per input
partition.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.expressions import (
    MICROS_PER_DAY,
    affinity_weight,
    is_type,
    is_view,
    moment,
    revenue,
)
from basketry.operators.enrich import attach_category
from basketry.schemas import AFFINITY_TYPES, CUSTOMER

MONEY = "decimal(12,2)"


def count_measures() -> list[Column]:
    return [
        F.count_if(is_view()).alias("total_views"),
        F.count_if(is_type("add_to_cart")).alias("total_cart_adds"),
        F.count_if(is_type("purchase")).alias("total_purchases"),
    ]


def activity_counts(events: DataFrame) -> DataFrame:
    """Views (page and product), cart adds and purchases per customer."""
    return events.groupBy(*CUSTOMER).agg(*count_measures())


def distinct_counts(events: DataFrame, products: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct products and categories that any event of the customer names.

    Events are folded to one row per customer and product before they meet the products. With
    ``approximate`` products are counted by a sketch (1.6 percent standard error) in one pass over
    the events, so a customer of very many products costs a bounded row; categories are few.
    """
    if approximate:
        named = attach_category(events.select(*CUSTOMER, "product_id"), products, "customer_id")
        return named.groupBy(*CUSTOMER).agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("product_id", F.lit(12))).alias("distinct_products_viewed"),
            F.size(F.collect_set("category")).cast("bigint").alias("distinct_categories_viewed"),
        )
    touched = attach_category(events.select(*CUSTOMER, "product_id").distinct(), products, "customer_id")
    return count_touched(touched)


def count_touched(touched: DataFrame) -> DataFrame:
    """The counts, from rows of customer, product and category."""
    return touched.groupBy(*CUSTOMER).agg(
        F.count_distinct("product_id").alias("distinct_products_viewed"),
        F.count_distinct("category").alias("distinct_categories_viewed"),
    )


def recency_days(events: DataFrame, as_of: str | datetime) -> DataFrame:
    """Whole days from the first and the last event date to ``as_of``."""
    return (
        events.groupBy(*CUSTOMER)
        .agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))
        .select(
            *CUSTOMER,
            days_since(F.col("first_ts"), as_of).alias("days_since_first_seen"),
            days_since(F.col("last_ts"), as_of).alias("days_since_last_activity"),
        )
    )


def days_since(ts: Column, as_of: str | datetime) -> Column:
    return F.datediff(F.to_date(moment(as_of)), F.to_date(ts))


def category_affinity_rows(
    events: DataFrame, products: DataFrame, as_of: str | datetime
) -> DataFrame:
    """Recency-weighted score per customer and category; stale categories keep score 0.

    Events are folded to one row per customer and product before they meet the products.
    """
    touches = product_touches(events, as_of).filter("affinity_events > 0")
    return (
        attach_category(touches, products)
        .filter(F.col("category").isNotNull())
        .groupBy(*CUSTOMER, "category")
        .agg(F.sum("weight").cast("double").alias("affinity_score"))
    )


def category_affinity_map(affinity_rows: DataFrame) -> DataFrame:
    """The scores of a customer as one map; it holds one entry per catalogue category."""
    entries = F.collect_list(F.struct("category", "affinity_score"))
    return affinity_rows.groupBy(*CUSTOMER).agg(
        F.map_from_entries(F.array_sort(entries)).alias("category_affinity")
    )


def mean_gap_days(first_us: Column, last_us: Column, purchases: Column) -> Column:
    """Mean gap of consecutive purchases: the gaps add up to last minus first."""
    return F.when(
        purchases > 1, (last_us - first_us) / (purchases - 1) / F.lit(float(MICROS_PER_DAY))
    )


def purchase_gaps(events: DataFrame) -> DataFrame:
    """Mean days between purchases of each buyer; NULL after a single purchase."""
    return (
        events.filter(is_type("purchase"))
        .groupBy(*CUSTOMER)
        .agg(
            F.min(F.unix_micros("timestamp")).alias("first_us"),
            F.max(F.unix_micros("timestamp")).alias("last_us"),
            F.count("*").alias("n"),
        )
        .select(
            *CUSTOMER,
            mean_gap_days(F.col("first_us"), F.col("last_us"), F.col("n")).alias(
                "avg_days_between_purchases"
            ),
        )
    )


def purchase_revenue(events: DataFrame, on_bad: str = "fail") -> DataFrame:
    """Total revenue of each buyer and the mean of the orders that brought any."""
    amount = F.col("revenue") if "revenue" in events.columns else revenue(
        F.col("properties"), on_bad
    )
    paid = F.when(amount > 0, amount)
    return (
        events.filter(is_type("purchase"))
        .groupBy(*CUSTOMER)
        .agg(
            F.sum(amount).alias("total"),
            F.sum(paid).alias("paid_total"),
            F.count(paid).alias("paid_n"),
        )
        .select(
            *CUSTOMER,
            F.col("total").cast(MONEY).alias("total_revenue"),
            mean_order(F.col("paid_total"), F.col("paid_n")).alias("avg_order_value"),
        )
    )


def mean_order(paid_total: Column, paid_n: Column) -> Column:
    return F.when(paid_n > 0, paid_total / paid_n).cast(MONEY)


def product_touches(events: DataFrame, as_of: str | datetime) -> DataFrame:
    """One row per customer and product: affinity weight and number of affinity events."""
    counts_for_affinity = F.col("event_type").isin(*AFFINITY_TYPES)
    return (
        events.filter(F.col("product_id").isNotNull())
        .groupBy(*CUSTOMER, "product_id")
        .agg(
            F.sum(
                F.when(counts_for_affinity, affinity_weight(F.col("timestamp"), as_of))
            ).alias("weight"),
            F.count_if(counts_for_affinity).alias("affinity_events"),
        )
    )


def product_features(touches: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct counts and the affinity map, from one row per customer and product."""
    by_category = (
        attach_category(touches, products)
        .groupBy(*CUSTOMER, "category")
        .agg(
            F.count("*").alias("n_products"),
            F.sum("weight").alias("weight"),
            F.sum("affinity_events").alias("affinity_events"),
        )
    )
    scored = F.when(
        F.col("category").isNotNull() & (F.col("affinity_events") > 0),
        F.struct("category", F.col("weight").cast("double").alias("affinity_score")),
    )
    return by_category.groupBy(*CUSTOMER).agg(
        F.sum("n_products").alias("distinct_products_viewed"),
        F.count("category").alias("distinct_categories_viewed"),
        F.map_from_entries(F.array_sort(F.collect_list(scored))).alias("category_affinity"),
    )


def basic_features(events: DataFrame, products: DataFrame, as_of: str | datetime) -> DataFrame:
    """Counts, distinct counts and day counts only."""
    base = (
        events.groupBy(*CUSTOMER)
        .agg(
            *count_measures(),
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
        )
        .withColumn("days_since_first_seen", days_since(F.col("first_ts"), as_of))
        .withColumn("days_since_last_activity", days_since(F.col("last_ts"), as_of))
    )
    touches = events.filter(F.col("product_id").isNotNull()).select(
        *CUSTOMER, "product_id"
    ).distinct()
    distinct = count_touched(attach_category(touches, products))
    return base.join(distinct, CUSTOMER, "left").select(
        *CUSTOMER,
        "total_views",
        "total_cart_adds",
        "total_purchases",
        F.coalesce("distinct_products_viewed", F.lit(0)).alias("distinct_products_viewed"),
        F.coalesce("distinct_categories_viewed", F.lit(0)).alias("distinct_categories_viewed"),
        "days_since_first_seen",
        "days_since_last_activity",
    )
