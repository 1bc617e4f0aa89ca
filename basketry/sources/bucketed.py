"""Tables that are stored in the partitioning the daily jobs need, so that these shuffle nothing.

A customer's rows lie in one bucket, sorted. Grouping, windows and joins on the customer then read
the buckets as they are. Store folded rows this way (``feature_state.folded``), whose number for a
customer is bounded by time and catalogue: raw events of one very busy customer would be one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from basketry.schemas import CUSTOMER

# Tables that are to be joined without a shuffle need the same number.
BUCKETS = 64


def write_bucketed(
    rows: DataFrame, table: str, path: str, buckets: int = BUCKETS, keys: Sequence[str] = CUSTOMER, sort_by: Sequence[str] = ()
) -> DataFrame:
    """Store ``rows`` in ``path`` as the catalog table ``table``, one file for each bucket; returns the table."""
    first, *others = keys
    order = [*keys, *(c for c in sort_by if c not in keys)]
    writer = rows.repartition(buckets, *keys).sortWithinPartitions(*order).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, first, *others).sortBy(order[0], *order[1:]).saveAsTable(table)
    return rows.sparkSession.table(table)


def shuffled_by(df: DataFrame, key: str) -> bool:
    """Whether the plan shuffles rows by a hash of ``key``."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("hashpartitioning(" in line and f"{key}#" in line.split("hashpartitioning(")[1] for line in plan.splitlines())


def drop_bucketed(spark: SparkSession, table: str) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
