"""Columns by exact name, and the place of every row in a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.session import materialize


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever others are called (by case, dots or backticks)."""
    at = [df.columns.index(name) for name in names]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, names)))


def placed(rows: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Add ``place``, the number of rows before this one; written to the shared folder.

    The order is made by a range shuffle; a row's place is its place in its partition plus the sizes
    of the partitions before, of which one number each comes to the driver. ``order`` should end with
    a column that tells equal rows apart, so that a large group of them is split over tasks.
    """
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    found = materialize(rows.orderBy(*order).select("*", F.spark_partition_id().alias("part__"), in_part.alias("nth__")), name)
    before, offset = [], 0
    for part, size in sorted(found.groupBy("part__").count().collect()):
        before.append((part, offset))
        offset += size
    schema = T.StructType([T.StructField("part__", T.IntegerType()), T.StructField("before__", T.LongType())])
    starts = rows.sparkSession.createDataFrame(before, schema)
    return found.join(starts, "part__").select(*rows.columns, (F.col("before__") + F.col("nth__")).alias("place"))


def plain(docs: DataFrame, need: tuple[str, ...], own: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns of plain names, and their given names.

    Columns in ``need`` are found by exact name and keep it; the others have names that meet no other.
    Columns named like one of ``own``, which the caller is going to add, are left out.
    """
    taken = {name.lower() for name in own}
    at = [i for i, name in enumerate(docs.columns) if name.lower() not in taken]
    first = {name: docs.columns.index(name) for name in need}
    inner = [next((n for n, k in first.items() if k == i), f"c{i}") for i in at]
    every = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return every.select(*(F.col(f"c{i}").alias(n) for i, n in zip(at, inner))), [docs.columns[i] for i in at]


def appended(docs: DataFrame, run, extra: str, *need: str) -> DataFrame:
    """``docs`` with the columns that ``run`` (see mapInArrow) adds, ``extra`` in DDL; any of the same name are replaced."""
    added = T.StructType.fromDDL(extra)
    inner, names = plain(docs, need, tuple(added.names))
    return inner.mapInArrow(run, T.StructType(inner.schema.fields + added.fields)).toDF(*names, *added.names)
