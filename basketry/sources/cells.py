"""Keyed tables of which a change rewrites only the cells it touches.

A table's rows are dealt to cells: by the values of the partition columns, and within these by a
hash of the keys. A version is a manifest, a small table that names the files of every cell with
their rows. A write adds files for the cells it touches and publishes a manifest that names these
and, for all other cells, the files there are. Files never change, so readers see one version or
the next, and a crash before the manifest is complete leaves the old one.

    root/data/<write>/__part=<digest of the partition values>/__cell=<n>/*.parquet
    root/v=<n>/files   the manifest; root/v=<n>/_SUCCESS makes the version count
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.operators.merge import upsert_by_key
from basketry.session import materialize
from basketry.sources.versions import DONE, exists, fs_of, next_version, versions

# Cells of a partition. A large tenant's rows are spread over so many, a change of few keys
# rewrites so small a part; a small tenant has as many files.
CELLS = 16
CELL = ["__part", "__cell"]


def is_cells(spark: SparkSession, root: str, version: int) -> bool:
    return exists(spark, f"{root}/v={version}/files")


def entries(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The manifest of a version, by default the newest: partition values, cell, file, rows."""
    found = versions(spark, root)
    return spark.read.parquet(f"{root}/v={version or found[-1]}/files")


def _dealt(rows: DataFrame, keys: Sequence[str], partition_by: Sequence[str], cells: int) -> DataFrame:
    """``rows`` with the cell of each."""
    values = F.to_json(F.struct(*partition_by), {"ignoreNullFields": "false"}) if partition_by else F.lit("")
    within = [k for k in keys if k not in partition_by] or list(keys)
    return rows.withColumns({"__part": F.md5(values), "__cell": F.pmod(F.xxhash64(*within), F.lit(cells)).cast("int")})


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)))


def _read(spark: SparkSession, root: str, files: DataFrame, schema: str) -> DataFrame:
    """The rows of the files in a manifest. The driver has their names, as for every scan."""
    paths = [f"{root}/{r.path}" for r in files.where("path is not null").select("path").collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(dealt: DataFrame, root: str, schema: str, partition_by: Sequence[str], cells: int, sort_by: Sequence[str], options: dict[str, str]) -> DataFrame:
    """Write rows to new files; returns their manifest."""
    spark, write = dealt.sparkSession, uuid4().hex
    folder = f"{root}/data/{write}"
    out = dealt.hint("rebalance", *CELL).sortWithinPartitions(*CELL, *sort_by)
    out.write.partitionBy(*CELL).options(**options).parquet(folder)
    held = spark.read.schema(f"{schema}, __part STRING, __cell INT").parquet(folder)
    name = F.concat(
        F.lit(f"data/{write}/__part="), "__part", F.lit("/__cell="), F.col("__cell").cast("string"), F.lit("/"), F.col("_metadata.file_name")
    )
    return held.select(*partition_by, *CELL, name.alias("path")).groupBy(*CELL, "path").agg(
        *(F.first(c).alias(c) for c in partition_by), F.count("*").alias("rows")
    ).select(*partition_by, *CELL, "path", "rows", F.lit(cells).alias("cells"), F.lit(None).cast("string").alias("note"))


def _publish(manifest: DataFrame, root: str) -> int:
    """Publish a version; of two writers that pick the same number the second fails."""
    spark = manifest.sparkSession
    version = next_version(spark, root)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{root}/v={version}/files")
    _complete(spark, root, version)
    return version


def _complete(spark: SparkSession, root: str, version: int) -> None:
    done, fs = fs_of(spark, f"{root}/v={version}/{DONE}")
    fs.create(done, False).close()


def _stored(spark: SparkSession, root: str, schema: str, partition_by: Sequence[str], cells: int) -> tuple[DataFrame | None, DataFrame | None, int]:
    """Manifest of the newest version, or the rows of one that is a plain folder, and the cells of a partition."""
    found = versions(spark, root)
    if not found:
        return None, None, cells
    if not is_cells(spark, root, found[-1]):
        return None, spark.read.schema(schema).parquet(f"{root}/v={found[-1]}"), cells
    manifest = entries(spark, root)
    first = manifest.select("cells").first()
    return manifest, None, first.cells if first else cells


def read(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """The table, of the newest version by default."""
    return _read(spark, root, entries(spark, root, version), schema)


def upsert(
    updates: DataFrame,
    root: str,
    keys: Sequence[str],
    schema: str,
    partition_by: Sequence[str] = (),
    cells: int = CELLS,
    sort_by: Sequence[str] = (),
    options: dict[str, str] | None = None,
) -> int:
    """Insert or replace rows by key; rewrites only cells that hold a key of ``updates``.

    ``partition_by`` must be among the keys. A table keeps the number of cells it began with. A
    version that is a plain folder is dealt to cells by the first upsert.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError("the partition columns must be among the keys")
    spark = updates.sparkSession
    manifest, plain, cells = _stored(spark, root, schema, partition_by, cells)
    new = materialize(_dealt(_typed(updates, schema), keys, partition_by, cells), "upserted")
    if manifest is None:
        old, carried = plain if plain is not None else spark.createDataFrame([], schema), None
    else:
        touched = new.select(*CELL).distinct()
        old = _read(spark, root, manifest.join(touched, CELL, "left_semi"), schema)
        carried = manifest.join(touched, CELL, "left_anti")
    merged = upsert_by_key(_dealt(old, keys, partition_by, cells), new, list(keys))
    written = _write(merged, root, schema, partition_by, cells, sort_by, options or {})
    return _publish(written if carried is None else carried.unionByName(written), root)


def remove(
    gone: DataFrame, root: str, keys: Sequence[str], schema: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), options: dict[str, str] | None = None
) -> int | None:
    """Take out the rows whose keys ``gone`` has; rewrites only cells that may hold one. None if the table has no version."""
    spark = gone.sparkSession
    manifest, plain, cells = _stored(spark, root, schema, partition_by, CELLS)
    if manifest is None and plain is None:
        return None
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
    named = _dealt(gone.select(*(F.col(k).cast(types[k]).alias(k) for k in keys)).distinct(), keys, partition_by, cells)
    named = materialize(named, "removed")
    old, carried = plain, None
    if manifest is not None:
        touched = named.select(*CELL).distinct()
        old = _read(spark, root, manifest.join(touched, CELL, "left_semi"), schema)
        carried = manifest.join(touched, CELL, "left_anti")
    left = _dealt(old, keys, partition_by, cells).join(named.select(*keys), list(keys), "left_anti")
    written = _write(left.select(*types, *CELL), root, schema, partition_by, cells, sort_by, options or {})
    return _publish(written if carried is None else carried.unionByName(written), root)


def replace(
    rows: DataFrame,
    root: str,
    refreshed: DataFrame,
    keys: Sequence[str],
    schema: str,
    partition_by: Sequence[str],
    cells: int = CELLS,
    sort_by: Sequence[str] = (),
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Replace all rows of the partitions in ``refreshed``; returns those of them that lost all their rows.

    Rows of other partitions are left out. No file of another partition is read or written.
    """
    spark, by = rows.sparkSession, list(partition_by)
    named = _dealt(refreshed.select(*by).distinct(), by, by, 1).select("__part")
    named = materialize(named, "refreshed")
    manifest, plain, cells = _stored(spark, root, schema, by, cells)
    new = _dealt(_typed(rows, schema), keys, by, cells).join(named, "__part", "left_semi")
    carried = had = None
    if manifest is not None:
        carried, had = manifest.join(named, "__part", "left_anti"), manifest.join(named, "__part", "left_semi")
    elif plain is not None:
        dealt = _dealt(plain, keys, by, cells)
        had = materialize(dealt.join(named, "__part", "left_semi").select(*by, "__part").distinct(), "had")
        new = dealt.join(named, "__part", "left_anti").unionByName(new.select(*dealt.columns))
    written = materialize(_write(new, root, schema, by, cells, sort_by, options or {}), "written")
    _publish(written if carried is None else carried.unionByName(written), root)
    if had is None:
        return written.select(*by).limit(0)
    return had.join(written, "__part", "left_anti").select(*by).distinct()


def append(
    rows: DataFrame,
    root: str,
    keys: Sequence[str],
    schema: str,
    partition_by: Sequence[str] = (),
    cells: int = CELLS,
    note: str | None = None,
    options: dict[str, str] | None = None,
) -> int | None:
    """Add rows to the cells of their keys, in new files; all files there are stay.

    A ``note`` names what is added and is published with it: a second append with a note that the
    table has does nothing and returns None, so that a batch replayed after a crash counts once.
    """
    spark = rows.sparkSession
    manifest, plain, cells = _stored(spark, root, schema, partition_by, cells)
    if manifest is not None and note is not None and not manifest.where(F.col("note") == note).isEmpty():
        return None
    new = _typed(rows, schema)
    if plain is not None:
        new = plain.unionByName(new)
    written = _write(_dealt(new, keys, partition_by, cells), root, schema, partition_by, cells, (), options or {})
    if manifest is not None:
        written = manifest.unionByName(written)
    if note is not None:
        written = written.unionByName(spark.createDataFrame([(cells, note)], "cells INT, note STRING"), allowMissingColumns=True)
    return _publish(written, root)


def compact(
    spark: SparkSession,
    root: str,
    keys: Sequence[str],
    schema: str,
    merge: Callable[[DataFrame], DataFrame],
    partition_by: Sequence[str] = (),
    most: int = 4,
    options: dict[str, str] | None = None,
) -> int | None:
    """Rewrite the cells that have more than ``most`` files, their rows put together by ``merge``; None if there are none.

    ``merge`` must keep the keys of a row, so that it stays in its cell.
    """
    manifest = entries(spark, root)
    full = materialize(manifest.where("path is not null").groupBy(*CELL).count().where(F.col("count") > most).select(*CELL), "full-cells")
    if full.isEmpty():
        return None
    cells = manifest.select("cells").first().cells
    held = merge(_read(spark, root, manifest.join(full, CELL, "left_semi"), schema))
    written = _write(_dealt(_typed(held, schema), keys, partition_by, cells), root, schema, partition_by, cells, (), options or {})
    return _publish(manifest.join(full, CELL, "left_anti").unionByName(written), root)


def lookup(
    wanted: DataFrame, root: str, keys: Sequence[str], schema: str, partition_by: Sequence[str] = (), version: int | None = None
) -> DataFrame:
    """The stored rows whose keys ``wanted`` has; reads only the cells that may hold them."""
    spark = wanted.sparkSession
    found = versions(spark, root)
    if not found:
        return spark.createDataFrame([], schema)
    manifest = entries(spark, root, version)
    first = manifest.select("cells").first()
    if first is None:
        return spark.createDataFrame([], schema)
    types = {f.name: f.dataType for f in T.StructType.fromDDL(schema)}
    asked = wanted.select(*(F.col(k).cast(types[k]).alias(k) for k in keys)).distinct()
    touched = _dealt(asked, keys, partition_by, first.cells).select(*CELL).distinct()
    return _read(spark, root, manifest.join(touched, CELL, "left_semi"), schema).join(asked, list(keys), "left_semi")


def prune_files(spark: SparkSession, root: str, removed: list[int], kept: list[int]) -> int:
    """Delete the files that only ``removed`` versions name; returns how many. Call it before their manifests go."""
    old = [entries(spark, root, v).where("path is not null").select("path") for v in removed if is_cells(spark, root, v)]
    live = [entries(spark, root, v).select("path") for v in kept if is_cells(spark, root, v)]
    if not old:
        return 0
    gone = old[0]
    for more in old[1:]:
        gone = gone.unionAll(more)
    gone = gone.distinct()
    for more in live:
        gone = gone.join(more, "path", "left_anti")
    paths = [r.path for r in gone.collect()]
    for path in paths:
        hpath, fs = fs_of(spark, f"{root}/{path}")
        fs.delete(hpath, False)
    return len(paths)
