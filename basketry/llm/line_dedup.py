"""Drop lines that repeat across documents, keeping the document that holds them first."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm import _bloom
from basketry.llm._order import pick, plain
from basketry.session import materialize

# Fixed values of the operator: white space stripped from a line, and the least code points of a key.
BLANK = b" \t\n\x0b\x0c\r"
LEAST = 10
PACK = "segment int, hashes binary"


def key_of(line: bytes, least: int = LEAST) -> bytes | None:
    """The line stripped and with A-Z lower-cased, or None if it is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key


def _keys(text: str | None, least: int) -> list[bytes]:
    return [k for x in (text or "").encode().split(b"\n") if (k := key_of(x, least)) is not None]


def _hash_batches(least: int, segments: int):
    """Hashes of the keys of each document, each at most twice in a batch, packed by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: list[int] = []
            for text in batch.column(0):
                seen += {xxhash.xxh3_64_intdigest(k) for k in _keys(text.as_py(), least)}
            found, count = np.unique(np.array(seen, np.uint64), return_counts=True)
            found = np.concatenate([found, found[count > 1]])
            which = _bloom.segment_of(found, segments)
            order = np.argsort(which, kind="stable")
            names, at = np.unique(which[order], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int32)), pa.array([x.tobytes() for x in np.split(found[order], at[1:])] if len(names) else [], pa.binary())],
                ["segment", "hashes"],
            )

    return run


def twice_filter(docs: DataFrame, least: int = LEAST, segments: int = _bloom.SEGMENTS, max_bits: int = _bloom.MAX_BITS) -> _bloom.Segmented:
    """A filter that holds every key hash seen in two documents, and few others.

    Only 8-byte hashes move, a frequent one at most twice from each batch. A segment keeps the
    hashes seen once and seen twice in two Bloom filters; the second comes back. It is sized by its
    share of the input and never above ``max_bits`` in all (32 MB by default), so it may be
    broadcast; above that bound more keys are suspected, and the exact step has more to do.
    """

    def build(group: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]])
        size = _bloom.bits_for(len(hashes), segments, max_bits) // 8
        filters = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        _bloom.sightings(hashes, filters)
        return pd.DataFrame({"segment": [group["segment"].iloc[0]], "hashes": [filters[1].tobytes()]})

    packed = docs.select("text").mapInArrow(_hash_batches(least, segments), PACK)
    rows = packed.groupBy("segment").applyInPandas(build, PACK).collect()
    return _bloom.Segmented({r.segment: bytes(r.hashes) for r in rows}, segments)


def _suspects(twice, least: int):
    """Append n_lines, and the digests of the suspected keys (null if there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = twice.value
        for batch in batches:
            lines, owner, keys, hashes = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                lines.append(text.count("\n") + 1)
                for key in set(_keys(text, least)):
                    owner.append(i)
                    keys.append(key)
                    hashes.append(xxhash.xxh3_64_intdigest(key))
            digests: list[list[bytes] | None] = [None] * len(lines)
            for j in np.flatnonzero(filter_.has(np.array(hashes, np.uint64))):
                if digests[owner[j]] is None:
                    digests[owner[j]] = []
                digests[owner[j]].append(sha256(keys[j]).digest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lines, pa.int64()), pa.array(digests, pa.list_(pa.binary()))],
                [*batch.schema.names, "__n_lines", "__digests"],
            )

    return run


def _drop(least: int):
    """Replace text by its kept lines, and append the number of dropped ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, dropped = [], []
            for text, gone in zip(batch.column("text"), batch.column("__gone")):
                gone = gone.as_py()
                if not gone:
                    texts.append(text.as_py())
                    dropped.append(0)
                    continue
                gone, all_lines = set(gone), text.as_py().encode().split(b"\n")
                kept = [x for x in all_lines if (k := key_of(x, least)) is None or sha256(k).digest() not in gone]
                texts.append(b"\n".join(kept).decode())
                dropped.append(len(all_lines) - len(kept))
            at = batch.schema.get_field_index("text")
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped, pa.int64())], [*batch.schema.names, "__n_dropped"])

    return run


def _with(docs: DataFrame, extra: str) -> T.StructType:
    return T.StructType(docs.schema.fields + T.StructType.fromDDL(extra).fields)


def dedup_lines(docs: DataFrame, least: int = LEAST, segments: int = _bloom.SEGMENTS, max_bits: int = _bloom.MAX_BITS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, plus ``__n_lines`` and ``__n_dropped``.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. A key of at
    least ``least`` code points found in two documents or more loses all its lines, except in the
    document with the smallest id that holds it, which keeps all. A null text counts as one empty
    line and stays null; a text that loses every line becomes empty. Rows with one id are one
    document; null ids together are one document, after all others. Other columns pass unchanged.

    The texts are read twice: for the filters, and to look up keys in them. The second reading
    writes the rows, with the suspected keys, to the shared folder; after that only SHA-256 digests
    of suspected keys and the rows of documents that hold one are shuffled. Digests are counted by
    their smallest and largest id, so a key that very many documents hold is combined on the map side.
    """
    docs, names = plain(docs, ("doc_id", "text"), ("__n_lines", "__n_dropped"))
    spark = docs.sparkSession
    twice = spark.sparkContext.broadcast(twice_filter(docs, least, segments, max_bits))
    marked = materialize(docs.mapInArrow(_suspects(twice, least), _with(docs, "__n_lines long, __digests array<binary>")), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"))
    suspects = marked.where("__digests is not null").select(place.alias("place"), F.explode("__digests").alias("digest"))
    # Written, so that the join below has plain shuffles on both sides and Spark can split a frequent digest.
    repeated = materialize(
        suspects.groupBy("digest").agg(F.min("place").alias("first"), F.max("place").alias("end")).where("first < end"), "repeated"
    )
    gone = (
        suspects.join(repeated.select("digest", "first"), "digest")
        .where("place > first")
        .groupBy(F.col("place.doc_id").alias("__id"))
        .agg(F.collect_set("digest").alias("__gone"))
    )
    held = marked.where("__digests is not null")
    changed = held.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id", "__digests")
    kept = _with(docs, "__n_lines long, __gone array<binary>, __n_dropped long")
    changed = changed.select(*docs.columns, "__n_lines", "__gone").mapInArrow(_drop(least), kept).drop("__gone")
    same = marked.where("__digests is null").drop("__digests").withColumn("__n_dropped", F.lit(0).cast("long"))
    return same.unionByName(changed).select(*docs.columns, "__n_lines", "__n_dropped").toDF(*names, "__n_lines", "__n_dropped")


def line_report(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs``."""
    return dedup_lines(pick(docs, "doc_id", "text"), **settings).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
