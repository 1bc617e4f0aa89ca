"""Keyed tables on plain Parquet: versioned publishing, upsert and tenant replacement (by ``cells``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.session import materialize
from basketry.sources import cells
from basketry.sources.versions import exists, fs_of, next_version
from basketry.sources.versions import versions as _versions


def publish(
    df: DataFrame,
    root: str,
    partition_by: list[str] | None = None,
    sort_by: list[str] | None = None,
) -> int:
    """Write the whole table as a new version; readers see it once it is complete.

    The version being read is never touched, so ``df`` may derive from it. A version is
    written once: of two writers that pick the same number the second fails. ``sort_by``
    orders the rows of each file, which narrows what a lookup has to read.
    """
    spark = df.sparkSession
    version = next_version(spark, root)
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/v={version}")
    return version


def current(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The newest complete version, or an empty table."""
    versions = _versions(spark, root)
    if not versions:
        return spark.createDataFrame([], schema)
    if cells.is_cells(spark, root, versions[-1]):
        return cells.read(spark, root, schema)
    return spark.read.schema(schema).parquet(f"{root}/v={versions[-1]}")


def prune_versions(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove all but the newest ``keep`` complete versions; returns those removed."""
    if keep < 1:
        raise ValueError("the current version must be kept")
    complete = _versions(spark, root)
    old = complete[:-keep]
    cells.prune_files(spark, root, old, complete[-keep:])
    for version in old:
        folder, fs = fs_of(spark, f"{root}/v={version}")
        fs.delete(folder, True)
    return old


def upsert_table(
    updates: DataFrame,
    root: str,
    keys: list[str],
    schema: str,
    partition_by: list[str] | None = None,
) -> int:
    """Insert or replace rows by key and publish the result; only cells with such keys are rewritten."""
    return cells.upsert(updates, root, keys, schema, partition_by or ())


def merge_table(updates: DataFrame, table: str, keys: list[str]) -> None:
    """The same upsert in place, for catalog tables whose format supports MERGE."""
    match = F.expr(" AND ".join(f"{table}.{key} = u.{key}" for key in keys))
    (
        updates.alias("u")
        .mergeInto(table, match)
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )


def append_new(
    rows: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None
) -> None:
    """Append the rows whose keys are not stored yet, one for each key, so a retry adds nothing.

    With ``partition_by``, which must be among the keys, only partitions that the rows name
    are compared.
    """
    spark = rows.sparkSession
    rows = materialize(rows.dropDuplicates(keys), "appended")
    if exists(spark, path):
        stored = spark.read.schema(rows.schema).parquet(path).select(*keys)
        if partition_by:
            touched = rows.select(*partition_by).distinct()
            stored = stored.join(touched, partition_by, "left_semi")
        rows = rows.join(stored, keys, "left_anti")
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_tenants(
    rows: DataFrame,
    root: str,
    refreshed: DataFrame,
    schema: str,
    sort_by: list[str] | None = None,
) -> DataFrame:
    """Replace all rows of the refreshed tenants; returns the tenants left without any.

    The files of other tenants stay as they are, and everything is published as one version, so
    readers see the old table or the new one. Rows of tenants that are not refreshed are left
    out. The tenants left without rows are those that had some before.
    """
    keys = ["tenant_id", *(sort_by or [])[:1]]
    return cells.replace(rows, root, refreshed, keys, schema, ["tenant_id"], sort_by=sort_by or ())
