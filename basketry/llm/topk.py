"""Exact top-k inner products from an impact-ordered index, processed score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm._vectors import rows_of
from basketry.session import materialize

# Components become floor(256 * x). Vectors within this are held as 32-bit integers, others as doubles,
# which hold these whole numbers exactly.
LIMIT = 1 << 27
SCALE = 256
LONG = np.iinfo(np.int64)  # the scores returned
# Impacts are quantised to steps of four; vectors of a block of the index, queries of a block.
STEP_BITS = 2
BLOCK, QUERIES = 32768, 512

PREPARED = "vec_id long, v binary, wide boolean"
INDEX = "block int, ids binary, rows binary, width int, wide boolean, vectors binary, postings binary, segments binary"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, packed, wide = [], [], []
        for i, x in zip(batch.column(0), rows_of(batch.column(1))):
            if x is not None and i.is_valid:
                ids.append(i.as_py())
                whole = np.floor(SCALE * x)
                wide.append(bool(np.abs(whole).max() > LIMIT))
                packed.append((whole if wide[-1] else whole.astype(np.int32)).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(wide, pa.bool_())], ["vec_id", "v", "wide"])


def _unpack(packed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(packed, np.float64 if wide else np.int32)


def _stack(packed: pd.Series, wide: pd.Series) -> np.ndarray:
    """Rows of whole numbers, as doubles if any needs it; shorter ones are filled up with zeros."""
    rows = [_unpack(x, w) for x, w in zip(packed, wide)]
    width = max(map(len, rows))
    out = np.zeros((len(rows), width), np.float64 if wide.any() else np.int32)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def build_index(group: pd.DataFrame) -> pd.DataFrame:
    """The postings of a block: for each dimension row numbers, by impact; a segment is a run of one level."""
    vectors = _stack(group["v"], group["wide"])
    n, width = vectors.shape
    postings = np.empty((width, n), np.int32)
    segments = []
    for d in range(width):
        level = vectors[:, d] >> STEP_BITS if vectors.dtype == np.int32 else np.floor(vectors[:, d] / (1 << STEP_BITS))
        postings[d] = np.argsort(level, kind="stable")
        ordered = level[postings[d]]
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        segments.append(np.stack([np.full(len(start), d), ordered[start], d * n + start, d * n + np.append(start[1:], n)], axis=1).astype(np.float64))
    return pd.DataFrame({
        "block": [group["block"].iloc[0]], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
        "rows": [group["row"].to_numpy(np.int64).tobytes()], "width": [width], "wide": [vectors.dtype != np.int32], "vectors": [vectors.tobytes()],
        "postings": [postings.tobytes()], "segments": [np.concatenate(segments).tobytes()],
    })


class Index:
    def __init__(self, row: pd.Series):
        self.ids, self.rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        self.vectors = _unpack(row["vectors"], row["wide"]).reshape(len(self.ids), row["width"])
        self.postings = np.frombuffer(row["postings"], np.int32)
        dim, self.level, start, end = np.frombuffer(row["segments"], np.float64).reshape(-1, 4).T
        self.dim, self.start, self.end = dim.astype(np.int64), start.astype(np.int64), end.astype(np.int64)
        self.top = np.abs(self.vectors).max(initial=0)

    def search(self, query: np.ndarray, own: int, k: int, steps: int = 8, few: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the best ``k`` vectors, ties to the smaller id.

        Segments are worked off by descending impact, the least possible contribution to a score
        counting as 0. A sum lacks at most the next impact in every dimension, and quantising makes
        it wrong by at most ``wrong``, which also covers the rounding of sums. Vectors whose upper bound is below the k-th lower bound are
        proved out. Once few are left, or all segments are done, those left are scored exactly.
        """
        n, width = self.vectors.shape
        q = np.zeros(width)
        q[: min(width, len(query))] = query[:width]
        middle = (1 << STEP_BITS) / 2 - 0.5
        impact = q[self.dim] * (self.level * (1 << STEP_BITS) + middle)
        first = np.flatnonzero(np.concatenate([[True], self.dim[1:] != self.dim[:-1]]))
        impact = impact - np.minimum.reduceat(impact, first)[self.dim]
        most = np.maximum.reduceat(impact, first)
        wrong = middle * np.abs(q).sum() + 1 + (width + 8) * 2.0**-51 * np.abs(q).sum() * (self.top + 4)
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        size = (self.end - self.start)[order]
        done = np.cumsum(size)
        few = max(4 * k, n // 64) if few is None else few
        sums, at, mine, left = np.zeros(n), 0, self.rows == own, np.arange(n)
        for step in range(1, steps + 1):
            to = len(order) if step == steps else int(np.searchsorted(done, done[-1] * step / steps, "right")) if len(done) else 0
            if to > at:
                part = order[at:to]
                where = np.concatenate([self.postings[a:b] for a, b in zip(self.start[part], self.end[part])])
                sums += np.bincount(where, np.repeat(impact[part], size[at:to]), n)
                at = to
            missing = np.minimum(most, impact[order[at]]).sum() if at < len(order) else 0.0
            others = sums[~mine] if mine.any() else sums
            floor = np.partition(others, len(others) - k)[len(others) - k] if len(others) > k else -np.inf
            left = np.flatnonzero((sums + missing + wrong >= floor - wrong) & ~mine)
            if len(left) <= few:
                break
        score = exact_products(self.vectors[left], q, self.top)
        best = np.lexsort((self.ids[left], -score))[:k] if score.dtype == np.int64 else sorted(range(len(left)), key=lambda i: (-score[i], self.ids[left[i]]))[:k]
        return left[best], score[best]


def sort_key(score: int) -> bytes:
    """Bytes in the order of the numbers: eight for those of 64 bits, so many as doubles may need for others."""
    if LONG.min <= score <= LONG.max:
        return b"\1" + (score - LONG.min).to_bytes(8, "big")
    return (b"\2" if score > 0 else b"\0") + (score + (1 << 2199)).to_bytes(276, "big")


def exact_products(vectors: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Inner products of whole numbers; as Python integers where 64 bits might not do."""
    if float(top) * float(np.abs(q).sum()) < 2.0**62:
        return vectors.astype(np.int64) @ q.astype(np.int64)
    numbers = [int(x) for x in q]
    return np.array([sum(int(x) * y for x, y in zip(row, numbers)) for row in vectors], object)


def _search(k: int):
    def run(_, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(index) and len(queries):
            block = Index(index.iloc[0])
            for own, query_id, v, wide in zip(queries["row"], queries["vec_id"], queries["v"], queries["wide"]):
                at, score = block.search(_unpack(v, wide), own, k)
                found += [(own, query_id, int(i), min(max(int(s), LONG.min), LONG.max), sort_key(int(s))) for i, s in zip(block.ids[at], score)]
        return pd.DataFrame(found, columns=["row", "query_id", "vec_id", "score", "key"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the greatest integer inner product.

    ``vectors`` has vec_id and embedding (a list of numbers); ``is_query`` is a condition on
    vec_id. All rows but the query's own are candidates, ties go to the smaller id. Rows whose id
    is null, and vectors that are null, empty or hold a null or non-finite component, take no part.
    A shorter vector counts as filled up with zeros. Scores are whole numbers of any size when ranked;
    those beyond 64 bits are returned as the nearest that these hold. Rows with one id are separate rows. Other
    columns are ignored; an empty table gives no rows.

    The index is cut by a hash of the id into blocks of about ``block`` vectors, written to the
    shared folder; each meets each block of queries in a task of its own, which holds one block of
    either. Only ``k`` rows per query and block leave it.
    """
    prepared = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_prepare, PREPARED)
    rows = materialize(prepared.select("*", F.monotonically_increasing_id().alias("row")), "vectors")
    asked = rows.where(is_query)
    n_rows, n_asked = rows.count(), asked.count()
    blocks, parts = max(1, -(-n_rows // block)), max(1, -(-n_asked // queries))

    def into(count: int):
        return F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    index = materialize(rows.withColumn("block", into(blocks)).groupBy("block").applyInPandas(build_index, INDEX), "index")
    left = index.withColumn("part", each(parts)).groupBy("block", "part")
    right = asked.withColumn("part", into(parts)).withColumn("block", each(blocks)).groupBy("block", "part")
    found = left.cogroup(right).applyInPandas(_search(k), "row long, query_id long, vec_id long, score long, key binary")
    best = Window.partitionBy("row").orderBy(F.desc("key"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
