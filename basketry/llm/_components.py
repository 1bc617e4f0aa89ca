"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.session import materialize


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n-1 the smallest node of their component."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low, new = np.minimum(x, y), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[local_components(len(nodes), at[: len(a)], at[len(a) :])]
        far = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge to another.

    ``edges`` holds longs ``a`` and ``b`` without nulls. Each Arrow batch is first contracted to
    stars, then every round ties all neighbours to their smallest (first those above a node, then
    those below), which takes a number of rounds logarithmic in the longest path. Only minima are
    aggregated, so a node with very many neighbours is combined on the map side, and its join is
    one that can be split. Rounds are written to the shared folder.
    """
    kept = edges.where("a is not null and b is not null and a <> b").select(
        F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")
    )
    now = materialize(kept.mapInArrow(_contract, "a long, b long").distinct(), "edges")
    print_of = None
    for _ in range(max_rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = (
            both.join(low, both.a == low.n)
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        down = large.where("a <> b")
        least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        tied = down.join(least, down.a == least.n)
        small = (
            tied.where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("n", "m"))
            .distinct()
        )
        now = materialize(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.col("a") % 1000003), F.sum(F.col("b") % 1000003)).first()
        if seen == print_of:
            break
        print_of = seen
    else:
        raise RuntimeError("the components did not settle")
    ties = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ties.union(now.select("b", "b").distinct())
