"""Stored recommendation lists with an index from products to the lists that name them.

Both are tables of cells. The index is written before the lists, and its rows stay when a list is
replaced: it names every list that has a product, and perhaps some that had it. So an update of few
products looks up few cells of the index, checks the lists these name, and rewrites only their cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.plans.recommend import LIST, STORED
from basketry.session import materialize
from basketry.sources import cells

INDEX = "tenant_id STRING, product_id STRING, customer_id STRING, surface STRING"
NAMED = ["tenant_id", "product_id"]
BY = ["tenant_id"]
ORDER = [*LIST, "rank"]


def store_lists(recs: DataFrame, lists_root: str, index_root: str) -> int:
    """Store lists; a customer's list for a surface replaces the one there is."""
    fresh = materialize(recs.select(*(c.split()[0] for c in STORED.split(", "))), "lists")
    cells.append(fresh.select(*NAMED, "customer_id", "surface").distinct(), index_root, NAMED, INDEX, BY)
    return cells.upsert(fresh, lists_root, LIST, STORED, BY, sort_by=ORDER)


def lists_naming(spark: SparkSession, products: DataFrame, lists_root: str, index_root: str) -> DataFrame:
    """Keys of the stored lists that name one of ``products`` (tenant_id, id), from the cells that may have them."""
    changed = materialize(products.select("tenant_id", F.col("id").alias("product_id")).distinct(), "changed")
    maybe = cells.lookup(changed, index_root, NAMED, INDEX, BY).select(*LIST).distinct()
    held = cells.lookup(materialize(maybe, "maybe"), lists_root, LIST, STORED, BY)
    return held.join(changed, NAMED, "left_semi").select(*LIST).distinct()


def drop_lists_naming(spark: SparkSession, products: DataFrame, lists_root: str, index_root: str) -> int:
    """Take out every list that names an updated product; returns how many went."""
    stale = materialize(lists_naming(spark, products, lists_root, index_root), "stale")
    gone = stale.count()
    if gone:
        cells.remove(stale, lists_root, LIST, STORED, BY, ORDER)
    return gone


def compact_index(spark: SparkSession, index_root: str, most: int = 4) -> int | None:
    """Merge the files of index cells with more than ``most``."""
    return cells.compact(spark, index_root, NAMED, INDEX, lambda rows: rows.distinct(), BY, most)
