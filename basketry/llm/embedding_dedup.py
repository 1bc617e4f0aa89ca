"""Near-duplicate vectors of a label, by int8 tile products with error bounds and exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm._components import connected_components, local_components
from basketry.llm._vectors import rows_of
from basketry.session import materialize

THRESHOLD = 0.93
# Distinct vectors of a block, rows of a tile that are multiplied at a time, and pairs checked at a time.
BLOCK, STRIP, PAIRS = 4096, 512, 1 << 16


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the vector as doubles, scaled by a power of two; null if it links with nothing."""
    for batch in batches:
        packed: list[bytes | None] = []
        for x in rows_of(batch.column(2)):
            top = np.abs(x).max() if x is not None else 0.0
            packed.append(None if top == 0 else (np.ldexp(x, -int(np.frexp(top)[1])) + 0.0).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["vec_id", "label", "v"])


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of unit vectors: int8 values, their scale, the length of what they stand for, and of the error."""
    scale = np.abs(vectors).max(axis=1) / 127
    small = np.rint(vectors / scale[:, None]).astype(np.int8)
    stood = small * scale[:, None]
    return small, scale, np.linalg.norm(stood, axis=1), np.linalg.norm(vectors - stood, axis=1)


def linked_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs with a cosine of at least ``threshold``; i < j only, if ``same``.

    For unit vectors x = x' + e and y = y' + f, with x', y' the quantised ones, the cosine differs
    from x'y' by at most |x'||f| + |e|. Products of int8 values are summed exactly in single
    precision (up to 2^24, that is 1040 components, else double). Pairs that may reach the
    threshold are computed again in double precision from the given vectors.
    """
    norm_a, norm_b = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, la, ea = quantise(a / norm_a[:, None])
    qb, sb, _, eb = quantise(b / norm_b[:, None])
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    fb = np.ascontiguousarray(qb.astype(kind).T)
    for i in range(0, len(a), STRIP):
        rows = slice(i, i + STRIP)
        about = (qa[rows].astype(kind) @ fb) * sa[rows, None].astype(kind) * sb[None].astype(kind)
        slack = la[rows, None].astype(kind) * eb[None].astype(kind) + (ea[rows, None] + 1e-5).astype(kind)
        x, y = np.nonzero(about + slack >= threshold)
        x = x + i
        if same:
            x, y = x[x < y], y[x < y]
        for j in range(0, len(x), PAIRS):
            p, q = x[j : j + PAIRS], y[j : j + PAIRS]
            cosine = np.einsum("ij,ij->i", a[p], b[q]) / (norm_a[p] * norm_b[q])
            yield p[cosine >= threshold], q[cosine >= threshold]


def _tile(threshold: float):
    """For each vector of a tile: how many others link with it, and the smallest id it is tied to."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        vectors = np.stack([np.frombuffer(x, np.float64) for x in group["v"]])
        ids, copies, right = (group[k].to_numpy() for k in ("rep", "copies", "right"))
        same = group["lo"].iloc[0] == group["hi"].iloc[0]
        left_at, right_at = np.flatnonzero(~right), np.flatnonzero(right)
        if same:
            right_at = left_at
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for p, q in linked_pairs(vectors[left_at], vectors[right_at], threshold, same) if len(left_at) and len(right_at) else ():
            p, q = left_at[p], right_at[q]
            links += np.bincount(p, copies[q], len(ids)).astype(np.int64) + np.bincount(q, copies[p], len(ids)).astype(np.int64)
            label = local_components(len(ids), np.concatenate([np.arange(len(ids)), place[p]]), np.concatenate([label, place[q]]))
        return pd.DataFrame({"rep": ids, "root": ids[order][label[place]], "links": links})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label).

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is at least ``threshold``. Null, empty and zero vectors, those with a null or
    non-finite component, and rows with a null id link with nothing; vectors of different lengths
    never link. n_links counts the other rows linked; component_id is the smallest id reachable
    (null for a null id), kept tells if that is the row's own. Other columns are ignored.

    Equal vectors of a label are first folded to one with a count. A label's vectors are dealt by
    hash to blocks of about ``block``, and every two blocks meet in a tile of their own. A tile
    returns one row per vector, its links counted and its ties as a tree, never its pairs. Rows are
    nodes by a number of their own: rows with one id are separate rows, whatever they hold.
    """
    source = vectors.select(F.col("vec_id").cast("long"), "label", "embedding")
    label_type = source.schema["label"].dataType.simpleString()
    rows = materialize(
        source.mapInArrow(_prepare, f"vec_id long, label {label_type}, v binary").select(
            "vec_id", "label", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), F.col("v")).alias("v")
        ).select("*", F.sha2("v", 256).alias("digest"), F.monotonically_increasing_id().alias("node")),
        "vectors",
    )
    classes = rows.where("v is not null").groupBy("label", "digest").agg(
        F.min("node").alias("rep"), F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"), F.length(F.first("v")).alias("width")
    )
    classes = materialize(classes, "classes")
    sizes = classes.groupBy("label", "width").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = classes.join(sizes, ["label", "width"]).withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "label", "width", "rep", "copies", "v",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("right"),
    )
    tiles = met.groupBy("label", "width", "lo", "hi").applyInPandas(_tile(threshold), "rep long, root long, links long")
    tied = materialize(tiles, "tiles")
    links = tied.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(tied.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = materialize(classes.select("rep", "low").join(components, F.col("rep") == F.col("node")).select("rep", "low", "component"), "tied")
    lowest = joined.groupBy("component").agg(F.min("low").alias("lowest"))
    known = (
        classes.select("label", "digest", "rep", "low", "copies")
        .join(links, "rep")
        .join(joined.select("rep", "component").join(lowest, "component").select("rep", "lowest"), "rep", "left")
        .select("label", "digest", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    )
    known = materialize(known, "classes").select(F.col("label").alias("l"), F.col("digest").alias("d"), "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.join(known, (F.col("label") == F.col("l")) & (F.col("digest") == F.col("d")), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
