"""Ranked recommendations for a table of requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.functions.expressions import before
from basketry.operators import candidates as c
from basketry.operators.requests import (
    REQUEST,
    check_requests,
    exclude_products,
    feature_lookup,
)
from basketry.schemas import CUSTOMER, MAX_LIMIT, MAX_SURFACE
from basketry.session import materialize
from basketry.sources import tables

BLOCK = 64
TOP = 100


def _floor_score(category: Column) -> Column:
    """The least final score of a product with this category score."""
    return F.round(c.blended_score(category, F.lit(0.0)), 4)


def request_categories(
    requests: DataFrame, features: DataFrame, leaders: DataFrame
) -> DataFrame:
    """The categories that make up each request's top 100 by affinity, without listing it.

    Per request and category:

    * ``max_id``: the last product id still within the 100, when the equally scored
      categories ``tied`` at the edge do not fit whole. It depends on the tied
      categories and the room left only, so it is found once per such combination.
    * ``ahead``: products with a greater final score.
    * ``floor``: the final score that ``needed`` products of the request reach.
    """
    sizes = leaders.groupBy("tenant_id", "category").agg(F.count("*").alias("size"))
    needed = (F.col("limit") + F.size("exclude_product_ids")).alias("needed")
    per_score = Window.partitionBy(*REQUEST, "affinity_score")
    down = Window.partitionBy(*REQUEST).orderBy(F.desc("affinity_score"))
    per_final = Window.partitionBy(*REQUEST, "final")
    down_final = Window.partitionBy(*REQUEST).orderBy(F.desc("final"))
    whole = Window.partitionBy(*REQUEST)
    placed = (
        feature_lookup(requests, features)
        .select(
            *REQUEST, needed, F.explode("category_affinity").alias("category", "affinity_score")
        )
        .join(sizes, ["tenant_id", "category"])
        .withColumn("group_size", F.sum("size").over(per_score))
        .withColumn("higher", F.sum("size").over(down) - F.col("group_size"))
        .filter(F.col("higher") < TOP)
        .withColumn("room", (TOP - F.col("higher")).cast("int"))
        .withColumn("cut", F.col("group_size") > F.col("room"))
        .withColumn("final", _floor_score(F.col("affinity_score")))
        .withColumn("reached", F.sum("size").over(down_final))
        .withColumn("ahead", F.col("reached") - F.sum("size").over(per_final))
        .withColumn(
            "floor",
            F.max(
                F.when(F.least("reached", F.lit(TOP)) >= F.col("needed"), F.col("final"))
            ).over(whole),
        )
        .select(*REQUEST, "needed", "category", "affinity_score", "ahead", "floor", "cut", "room")
    )
    placed = materialize(placed, "request-categories")

    # The tied categories are listed once per request, not on each of their rows.
    edges = (
        placed.filter("cut")
        .groupBy(*REQUEST, "affinity_score")
        .agg(F.array_sort(F.collect_list("category")).alias("tied"), F.first("room").alias("room"))
    )
    max_ids = (
        edges.select("tenant_id", "tied", "room").distinct()
        .select("*", F.explode("tied").alias("category"))
        .join(c.leader_lists(leaders), ["tenant_id", "category"])
        .groupBy("tenant_id", "tied", "room")
        .agg(F.flatten(F.collect_list(F.slice("ids", F.lit(1), F.col("room")))).alias("ids"))
        .select("tenant_id", "tied", "room",
                F.element_at(F.array_sort("ids"), F.col("room")).alias("max_id"))
    )
    limits = edges.join(max_ids, ["tenant_id", "tied", "room"]).select(
        *REQUEST, "affinity_score", "max_id"
    )
    return placed.join(limits, [*REQUEST, "affinity_score"], "left").drop("cut", "room")


def _in_top() -> Column:
    return F.col("max_id").isNull() | (F.col("product_id") <= F.col("max_id"))


def best_by_category(categories: DataFrame, leaders: DataFrame) -> DataFrame:
    """The affinity products that can be shown on their category score alone.

    A product behind ``needed`` others with at least its final score cannot.
    """
    return (
        categories.filter(F.col("ahead") < F.col("needed"))
        .join(c.leader_lists(leaders), ["tenant_id", "category"])
        .select(
            *REQUEST,
            "max_id",
            F.col("affinity_score").alias("category_score"),
            F.explode(F.slice("ids", F.lit(1), F.col("needed"))).alias("product_id"),
        )
        .filter(_in_top())
        .select(*REQUEST, "product_id", "category_score",
                F.lit(None).cast("double").alias("confidence"))
    )


def related_pairs(cooc: DataFrame) -> DataFrame:
    return cooc.filter(F.col("product_a_id") != F.col("product_b_id")).select(
        "tenant_id",
        F.col("product_a_id").alias("anchor_product_id"),
        F.col("product_b_id").alias("product_id"),
        "confidence",
    )


def pairs_in_categories(
    anchors: DataFrame, pairs: DataFrame, categories: DataFrame, leaders: DataFrame
) -> DataFrame:
    """Related products that are among the request's affinity products, with both scores.

    Only a category's leaders can be, so each anchor and category meets few pairs.
    """
    to_leaders = pairs.join(leaders, ["tenant_id", "product_id"])
    mine = categories.select(*REQUEST, "category", "affinity_score", "max_id")
    return (
        anchors.join(mine, REQUEST)
        .join(to_leaders, ["tenant_id", "anchor_product_id", "category"])
        .filter(_in_top())
        .select(*REQUEST, "product_id", F.col("affinity_score").alias("category_score"),
                "confidence")
    )


def best_pairs(
    anchors: DataFrame, requests: DataFrame, pairs: DataFrame, categories: DataFrame
) -> DataFrame:
    """Related products that can be shown on their pair score alone.

    A product is behind all better placed ones of the anchor it scores through, and it
    cannot be shown with ``needed`` of these ahead, nor below the request's ``floor``.
    Places are grouped in blocks, and a request joins only the blocks it needs, so an
    anchor with very many pairs costs no more than another.
    """
    score = F.round(c.blended_score(F.lit(0.0), F.col("confidence")), 4)
    best_first = Window.partitionBy("tenant_id", "anchor_product_id").orderBy(
        F.desc("pair_score"), "product_id"
    )
    placed = (
        pairs.withColumn("pair_score", score)
        .withColumn("place", F.row_number().over(best_first))
        .withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("int"))
    )
    floors = categories.groupBy(*REQUEST).agg(F.max("floor").alias("floor"))
    needed = F.col("limit") + F.size("exclude_product_ids")
    last_block = F.floor((F.col("needed") - 1) / BLOCK).cast("int")
    wanted = (
        anchors.join(requests.select(*REQUEST, needed.alias("needed")), REQUEST)
        .join(floors, REQUEST, "left")
        .withColumn("block", F.explode(F.sequence(F.lit(0), last_block)))
    )
    return (
        wanted.join(placed, ["tenant_id", "anchor_product_id", "block"])
        .filter(
            (F.col("place") <= F.col("needed"))
            & (F.col("floor").isNull() | (F.col("pair_score") >= F.col("floor")))
        )
        .select(*REQUEST, "product_id", F.lit(None).cast("double").alias("category_score"),
                "confidence")
    )


def recommend(
    requests: DataFrame,
    events: DataFrame,
    products: DataFrame,
    features: DataFrame,
    cooc: DataFrame,
    as_of: str | datetime,
) -> DataFrame:
    """Ranked items per request: affinity blended with related products, else popularity.

    The result is that of blending all 100 affinity products with all related products of
    the anchors, but rows that cannot be shown are never made: every row left out is
    behind ``limit`` plus the number of exclusions others (``needed``).

    Requests out of range get no rows, never fewer than they ask for; ``check_requests``
    lists them. Scores and confidences must not be negative. ``events`` needs the last 30
    days only.
    """
    requests, _ = check_requests(requests)
    leaders = c.category_leaders(products, TOP)
    categories = materialize(request_categories(requests, features, leaders), "categories")
    anchors = materialize(
        requests.select(*CUSTOMER, "request_id")
        .join(c.recent_anchors(events, as_of), CUSTOMER)
        .select(*REQUEST, F.col("product_id").alias("anchor_product_id")),
        "anchors",
    )
    pairs = related_pairs(cooc)
    rows = (
        best_by_category(categories, leaders)
        .unionByName(pairs_in_categories(anchors, pairs, categories, leaders))
        .unionByName(best_pairs(anchors, requests, pairs, categories))
    )
    blended = exclude_products(c.merge_candidates(rows), requests)
    ranked = materialize(c.rank_candidates(blended, requests), "ranked")

    popular = c.popularity(events, products, as_of, n=3 * MAX_LIMIT)
    fallback = c.popularity_fallback(requests, ranked, popular, shown_only=True)
    return ranked.unionByName(c.rank_candidates(fallback, requests))


def active_customers(events: DataFrame, as_of: str | datetime, span: str = "24 hours") -> DataFrame:
    """Customers with an event in the last ``span``."""
    return (
        events.filter(F.col("timestamp") >= before(as_of, span))
        .select(*CUSTOMER)
        .distinct()
    )


def precompute_requests(
    events: DataFrame, as_of: str | datetime, surface: str = "home", limit: int = 8
) -> DataFrame:
    """One request per recently active customer."""
    if not (1 <= limit <= MAX_LIMIT and 1 <= len(surface) <= MAX_SURFACE):
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}, surface 1 to {MAX_SURFACE} characters")
    return active_customers(events, as_of).select(
        F.concat_ws("/", "tenant_id", "customer_id", F.lit(surface)).alias("request_id"),
        *CUSTOMER,
        F.lit(surface).alias("surface"),
        F.lit(limit).alias("limit"),
        F.array().cast("array<string>").alias("exclude_product_ids"),
    )


def precompute_recommendations(
    events: DataFrame,
    products: DataFrame,
    features: DataFrame,
    cooc: DataFrame,
    as_of: str | datetime,
    surface: str = "home",
    limit: int = 8,
) -> DataFrame:
    """Recommendations for the active customers, keyed by tenant, customer and surface."""
    asked = precompute_requests(events, as_of, surface, limit)
    return recommend(asked, events, products, features, cooc, as_of).drop("request_id")


# The stored lists: what a surface shows a customer.
LIST = ["tenant_id", "customer_id", "surface"]
STORED = (
    "tenant_id STRING, customer_id STRING, surface STRING, rank INT, product_id STRING,"
    " score DOUBLE, reason STRING"
)


def store_recommendations(recs: DataFrame, root: str) -> int:
    """Publish precomputed lists; a customer's list for a surface replaces the stored one."""
    spark = recs.sparkSession
    fresh = materialize(recs.select(*(c.split()[0] for c in STORED.split(", "))), "lists")
    old = tables.current(spark, root, STORED)
    kept = old.join(fresh.select(*LIST).distinct(), LIST, "left_anti")
    return tables.publish(kept.unionByName(fresh), root, sort_by=[*LIST, "rank"])


def invalidate_stored(spark: SparkSession, root: str, updated_products: DataFrame) -> int:
    """Publish the stored lists without those that name an updated product."""
    left = invalidate_recommendations(tables.current(spark, root, STORED), updated_products)
    return tables.publish(left, root, sort_by=[*LIST, "rank"])


def invalidate_recommendations(recs: DataFrame, updated_products: DataFrame) -> DataFrame:
    """``recs`` without every list that names an updated product."""
    changed = updated_products.select("tenant_id", F.col("id").alias("product_id")).distinct()
    stale = recs.join(changed, ["tenant_id", "product_id"], "left_semi").select(*LIST).distinct()
    return recs.join(stale, LIST, "left_anti")
