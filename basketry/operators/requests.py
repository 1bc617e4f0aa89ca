"""Recommendation requests: defaults, range checks, features and exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.schemas import (
    CUSTOMER,
    DEFAULT_LIMIT,
    MAX_CUSTOMER_ID,
    MAX_LIMIT,
    MAX_SURFACE,
)

REQUEST = ["tenant_id", "request_id"]

LOOKUP_COLUMNS = [
    "category_affinity",
    "total_views",
    "total_purchases",
    "avg_days_between_purchases",
    "total_revenue",
    "avg_order_value",
    "avg_session_duration_seconds",
    "avg_products_viewed_per_session",
]


def request_is_valid() -> Column:
    return (
        F.length("customer_id").between(1, MAX_CUSTOMER_ID)
        & F.length("surface").between(1, MAX_SURFACE)
        & F.col("limit").between(1, MAX_LIMIT)
    )


def with_defaults(requests: DataFrame) -> DataFrame:
    """Fill in a missing ``limit`` and a missing exclusion list."""
    return requests.withColumns(
        {
            "limit": F.coalesce("limit", F.lit(DEFAULT_LIMIT)),
            "exclude_product_ids": F.coalesce(
                "exclude_product_ids", F.array().cast("array<string>")
            ),
        }
    )


def check_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests within the allowed ranges, and the others."""
    filled = with_defaults(requests)
    valid = F.coalesce(request_is_valid(), F.lit(False))
    return filled.filter(valid), filled.filter(~valid)


def feature_lookup(requests: DataFrame, features: DataFrame) -> DataFrame:
    """Each request with its customer's features; NULLs for an unknown customer."""
    return requests.join(features.select(*CUSTOMER, *LOOKUP_COLUMNS), CUSTOMER, "left")


def exclusions(requests: DataFrame) -> DataFrame:
    """One row per request and product it wants left out."""
    return requests.select(
        *REQUEST, F.explode("exclude_product_ids").alias("product_id")
    ).distinct()


def exclude_products(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates without excluded products, nor a product related to itself."""
    if "anchor_product_id" in candidates.columns:
        candidates = candidates.filter(F.col("product_id") != F.col("anchor_product_id"))
    return candidates.join(exclusions(requests), [*REQUEST, "product_id"], "left_anti")
