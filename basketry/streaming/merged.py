"""A stream of five-minute counts joined with the stored features, of their newest version at every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.operators.reports import merge_features
from basketry.schemas import CUSTOMER, CUSTOMER_FEATURES
from basketry.session import materialize
from basketry.sources import cells, tables
from basketry.sources.versions import versions

BY = ["tenant_id"]


def stored_for(customers: DataFrame, features_root: str) -> tuple[DataFrame, int]:
    """The stored features of these customers, and the version they are of; 0 if there is none.

    Of a table of cells only those with a wanted customer are read.
    """
    spark = customers.sparkSession
    found = versions(spark, features_root)
    if found and cells.is_cells(spark, features_root, found[-1]):
        return cells.lookup(customers, features_root, CUSTOMER, CUSTOMER_FEATURES, BY, found[-1]), found[-1]
    stored = tables.current(spark, features_root, CUSTOMER_FEATURES)
    return stored.join(customers.select(*CUSTOMER).distinct(), CUSTOMER, "left_semi"), found[-1] if found else 0


def merged_batch(counts: DataFrame, features_root: str) -> DataFrame:
    """Every row of ``counts`` under ``streaming`` with its customer's stored features, and ``features_version``.

    Customers without stored features have nulls for these.
    """
    stored, version = stored_for(counts, features_root)
    known = counts.select(*CUSTOMER).distinct().join(stored, CUSTOMER, "left")
    return merge_features(known, counts).withColumn("features_version", F.lit(version))


def start_merged_features(
    counts: DataFrame, features_root: str, path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Write each batch's changed counts, merged with the features stored by then, under ``batch=<id>``.

    A version published between two batches is used from the next one on; one batch sees one
    version. A retried batch replaces itself and may see a newer version.
    """

    def save(changed: DataFrame, batch_id: int) -> None:
        rows = materialize(changed, "changed")
        merged_batch(rows, features_root).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = counts.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=interval)
    return writer.start()


def latest_merged(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Each customer's newest row written by ``start_merged_features``: of the newest window, the last batch.

    With ``columns`` only these features, or ``streaming``, are read and returned.
    """
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*CUSTOMER, "batch") and (columns is None or c in columns)]
    newest = F.max_by(F.struct(*values), F.struct("streaming.window_start", "batch")).alias("row")
    return rows.groupBy(*CUSTOMER).agg(newest).select(*CUSTOMER, "row.*")
