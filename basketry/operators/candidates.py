"""Candidate products: recent anchors, category affinity, popularity, and their blend."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.expressions import before, is_type
from basketry.operators.requests import REQUEST, exclude_products
from basketry.schemas import (
    ANCHOR_TYPES,
    CATEGORY_WEIGHT,
    COOCCURRENCE_WEIGHT,
    CUSTOMER,
    POPULARITY_TYPES,
)


def recent_anchors(events: DataFrame, as_of: str | datetime, n: int = 5) -> DataFrame:
    """The ``n`` products each customer last viewed, carted or bought within 30 days."""
    latest_first = Window.partitionBy(*CUSTOMER).orderBy(F.desc("last_seen"), "product_id")
    return (
        events.filter(
            F.col("product_id").isNotNull()
            & F.col("event_type").isin(*ANCHOR_TYPES)
            & (F.col("timestamp") >= before(as_of, "30 days"))
        )
        .groupBy(*CUSTOMER, "product_id")
        .agg(F.max("timestamp").alias("last_seen"))
        .withColumn("rank", F.row_number().over(latest_first))
        .filter(F.col("rank") <= n)
    )


def category_leaders(products: DataFrame, n: int = 100) -> DataFrame:
    """The first ``n`` active products by id in each category.

    Products of a category share a customer's score, so no other can be among the top n.
    """
    by_id = Window.partitionBy("tenant_id", "category").orderBy("product_id")
    return (
        products.filter(F.col("active") & F.col("category").isNotNull())
        .select("tenant_id", "category", F.col("id").alias("product_id"))
        .withColumn("place", F.row_number().over(by_id))
        .filter(F.col("place") <= n)
        .drop("place")
    )


def leader_lists(leaders: DataFrame) -> DataFrame:
    """The leaders of each category as one array in id order."""
    return leaders.groupBy("tenant_id", "category").agg(
        F.array_sort(F.collect_list("product_id")).alias("ids")
    )


def leading_categories(
    features: DataFrame, leaders: DataFrame, n: int = 100, keys: list[str] = CUSTOMER
) -> DataFrame:
    """The categories that can supply a customer's top ``n``, with their scores.

    A category is dropped when those that score higher already hold ``n`` products.
    """
    sizes = leaders.groupBy("tenant_id", "category").agg(F.count("*").alias("size"))
    down_to_score = Window.partitionBy(*keys).orderBy(F.desc("affinity_score"))
    same_score = Window.partitionBy(*keys, "affinity_score")
    return (
        features.select(*keys, F.explode("category_affinity").alias("category", "affinity_score"))
        .join(sizes, ["tenant_id", "category"])
        .withColumn("higher", F.sum("size").over(down_to_score) - F.sum("size").over(same_score))
        .filter(F.col("higher") < n)
        .select(*keys, "category", "affinity_score")
    )


def affinity_candidates(
    features: DataFrame,
    products: DataFrame,
    n: int = 100,
    keys: list[str] = CUSTOMER,
) -> DataFrame:
    """Top ``n`` active products per row of ``features``, by category score then id."""
    leaders = category_leaders(products, n)
    return expand_categories(leading_categories(features, leaders, n, keys), leaders, n, keys)


def expand_categories(
    categories: DataFrame, leaders: DataFrame, n: int, keys: list[str]
) -> DataFrame:
    """The first ``n`` products of each key, by category score then id.

    A key's lists are put in order while they are one row, so no row of a product is sorted.
    """
    lists = categories.join(leader_lists(leaders), ["tenant_id", "category"]).select(
        *keys, (-F.col("affinity_score")).alias("below"), "ids"
    )
    scored = F.transform("ids", lambda i: F.struct(F.col("below").alias("below"), i.alias("product_id")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list(scored))), 1, n)
    return (
        lists.groupBy(*keys)
        .agg(best.alias("best"))
        .select(*keys, F.posexplode("best").alias("place", "product"))
        .select(
            *keys,
            (F.lit(0.0) - F.col("product.below")).alias("category_score"),
            F.col("product.product_id").alias("product_id"),
            (F.col("place") + 1).alias("rank"),
        )
    )


def popularity(
    events: DataFrame, products: DataFrame, as_of: str | datetime, n: int = 50
) -> DataFrame:
    """Top ``n`` active products per tenant: a view counts 1, a purchase 5, over 30 days."""
    counts = (
        events.filter(
            F.col("product_id").isNotNull()
            & F.col("event_type").isin(*POPULARITY_TYPES)
            & (F.col("timestamp") >= before(as_of, "30 days"))
        )
        .groupBy("tenant_id", "product_id")
        .agg(
            (
                F.count_if(is_type("product_view")) * F.lit(1.0)
                + F.count_if(is_type("purchase")) * F.lit(5.0)
            ).alias("score")
        )
    )
    active = products.filter("active").select("tenant_id", F.col("id").alias("product_id"))
    best_first = Window.partitionBy("tenant_id").orderBy(F.desc("score"), "product_id")
    return (
        counts.join(active, ["tenant_id", "product_id"])
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= n)
    )


def blend_candidates(
    affinity: DataFrame, related: DataFrame, keys: list[str] = REQUEST
) -> DataFrame:
    """One row per key and product, from affinity rows and related rows.

    ``affinity`` has ``category_score``, ``related`` has ``confidence``; the greatest
    confidence over all anchors counts. A union and one grouping do the work of an outer
    join.
    """
    none = F.lit(None).cast("double")
    rows = affinity.select(*keys, "product_id", "category_score", none.alias("confidence"))
    return merge_candidates(
        rows.unionByName(
            related.select(*keys, "product_id", none.alias("category_score"), "confidence")
        ),
        keys,
    )


def merge_candidates(rows: DataFrame, keys: list[str] = REQUEST) -> DataFrame:
    """Fold rows of ``category_score`` or ``confidence`` (or both) to one per product."""
    merged = rows.groupBy(*keys, "product_id").agg(
        F.max("category_score").alias("by_category"), F.max("confidence").alias("by_pair")
    )
    reason = (
        F.when(F.col("by_category").isNull(), "cooccurrence")
        .when((F.col("by_category") > 0) & F.col("by_pair").isNotNull(), "blended")
        .otherwise("category_affinity")
    )
    return merged.select(
        *keys,
        "product_id",
        F.coalesce("by_category", F.lit(0.0)).alias("category_score"),
        F.coalesce("by_pair", F.lit(0.0)).alias("cooccurrence_score"),
        reason.alias("reason"),
    )


def blended_score(category: Column, pair: Column) -> Column:
    return F.lit(CATEGORY_WEIGHT) * category + F.lit(COOCCURRENCE_WEIGHT) * pair


def rounded_score() -> Column:
    """The score of a blended row; popularity scores stand as they are."""
    raw = F.when(
        F.col("reason") == "global_popularity", F.col("cooccurrence_score")
    ).otherwise(blended_score(F.col("category_score"), F.col("cooccurrence_score")))
    return F.round(raw, 4)


def rank_candidates(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """The first ``limit`` candidates of each request, by rounded score then product id."""
    best_first = Window.partitionBy(*REQUEST).orderBy(F.desc("score"), "product_id")
    return (
        candidates.select(*REQUEST, "product_id", rounded_score().alias("score"), "reason")
        .join(requests.select(*REQUEST, "customer_id", "surface", "limit"), REQUEST)
        .withColumn("rank", F.row_number().over(best_first))
        .filter(F.col("rank") <= F.col("limit"))
        .select(*REQUEST, "customer_id", "surface", "rank", "product_id", "score", "reason")
    )


def popularity_fallback(
    requests: DataFrame, candidates: DataFrame, popular: DataFrame, shown_only: bool = False
) -> DataFrame:
    """For requests without any candidate, the tenant's top ``3 * limit`` popular products.

    Exclusions apply after the cut. A tenant's popular products become one array row, of
    which each request takes the part it reaches, so the requests of a large tenant can be
    split. ``popular`` must hold ``3 * limit`` rows of a tenant for its largest limit.
    ``shown_only`` leaves out rows behind ``limit`` plus the number of exclusions others,
    which ranking would drop.
    """
    reach = 3 * F.col("limit")
    if shown_only:
        reach = F.least(reach, F.col("limit") + F.size("exclude_product_ids"))
    waiting = requests.join(candidates.select(*REQUEST).distinct(), REQUEST, "left_anti")
    entry = F.struct("rank", "product_id", F.col("score").alias("cooccurrence_score"))
    lists = popular.groupBy("tenant_id").agg(
        F.array_sort(F.collect_list(entry)).alias("popular")
    )
    reached = F.slice("popular", F.lit(1), reach.cast("int"))
    # Of both sides the lists must travel: with few tenants they are too few rows to deal out.
    chosen = waiting.join(F.broadcast(lists), "tenant_id").select(*REQUEST, F.inline(reached))
    return exclude_products(
        chosen.select(
            *REQUEST,
            "product_id",
            F.lit(0.0).alias("category_score"),
            "cooccurrence_score",
            F.lit("global_popularity").alias("reason"),
        ),
        requests,
    )
