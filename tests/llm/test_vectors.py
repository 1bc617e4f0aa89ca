"""Operators on vectors, against brute force."""

import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import embedding_dedup, topk
from tests.llm.test_parts import find_roots

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, row STRING, v INT, copies INT"
ODD = [None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [0.0] * 7]


def table(spark, rows):
    return spark.createDataFrame([(i, x, label, "r", 1, 2) for i, x, label in rows], SCHEMA)


def vectors(n=120, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 8))
    out = []
    for i in range(n):
        x = centres[rng.integers(8)] + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.3])
        out.append((i * 5, [float(v) for v in (x / np.linalg.norm(x)).astype(np.float32)], int(rng.integers(3))))
    out += [(5000 + i, x, 1) for i, x in enumerate(ODD)]
    out += [(None, out[0][1], out[0][2]), (5050, out[0][1], None), (5100, [2 * v for v in out[1][1]], out[1][2]), out[2]]
    return out


def usable(x):
    return x is not None and len(x) > 0 and all(v is not None and math.isfinite(v) for v in x)


@pytest.mark.parametrize("block,queries", [(32768, 512), (40, 7)])
def test_top_k(spark, block, queries):
    rows = vectors()
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, 5, block, queries).collect()
    held = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x, _ in rows if i is not None and usable(x)]
    want = []
    for k, (i, x) in enumerate(held):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for m, (j, y) in enumerate(held) if m != k)[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_search_stops_only_on_proof():
    rng = np.random.default_rng(2)
    import pandas as pd

    values = rng.integers(-256, 256, (700, 12)).astype(np.int32)
    values[100:160] = values[0]
    group = pd.DataFrame({"wide": False, "block": 0, "vec_id": rng.permutation(700), "row": np.arange(700), "v": [x.tobytes() for x in values]})
    index = topk.Index(topk.build_index(group).iloc[0])
    for own in range(0, 700, 35):
        at, score = index.search(values[own], own, 5, steps=16, few=20)
        exact = values.astype(int) @ values[own].astype(int)
        order = sorted((j for j in range(700) if j != own), key=lambda j: (-exact[j], index.ids[j]))[:5]
        assert at.tolist() == order and score.tolist() == [exact[j] for j in order]


def test_top_k_of_few_and_none(spark):
    assert topk.top_k(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    two = [(50, [1.0, 0.0], 1), (51, [0.5, 0.5], 1)]
    assert [tuple(r) for r in topk.top_k(table(spark, two), F.col("vec_id") % 50 == 0).collect()] == [(50, 1, 51, 32768)]


@pytest.mark.parametrize("block", [4096, 16])
def test_near_duplicates(spark, block):
    rows = vectors(160, 3)
    got = embedding_dedup.near_duplicates(table(spark, rows), block=block).collect()

    def cosine(x, y):
        x, y = np.array(x, float), np.array(y, float)
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y)

    use = [k for k, (i, x, label) in enumerate(rows) if i is not None and label is not None and usable(x) and any(x)]
    links = [(a, b) for a, b in itertools.combinations(use, 2) if rows[a][2] == rows[b][2] and cosine(rows[a][1], rows[b][1]) >= 0.93]
    count = collections.Counter(x for pair in links for x in pair)
    root = find_roots([(rows[a][0], rows[b][0]) for a, b in links])
    want = [(i, count[k], root.get(i, i), i is not None and root.get(i, i) == i) for k, (i, _, _) in enumerate(rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_near_duplicates_of_none(spark):
    assert embedding_dedup.near_duplicates(table(spark, [])).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 64))
    x[100:] = x[:100] + rng.normal(size=(100, 64)) * 0.35
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, length, error = embedding_dedup.quantise(unit)
    about = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(about - unit @ unit.T) <= length[:, None] * error + error[:, None] + 1e-12).all()
    found = {(int(a), int(b)) for p, r in embedding_dedup.linked_pairs(x, x, 0.93, True) for a, b in zip(p, r)}
    exact = unit @ unit.T
    assert found == {(a, b) for a in range(200) for b in range(a + 1, 200) if exact[a, b] >= 0.93}


def test_top_k_of_large_components(spark):
    big = [600000.0, 700000.0, 524288.0, -3.0e7, 1.0e10, 1.0e30, -1.0e38, 3.0e38, 0.125]
    rows = [(50 * (i // 2) + 7 * (i % 2), [x, 1.0, y], 0) for i, (x, y) in enumerate(itertools.product(big, big))]
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 50 == 0, 5, 16, 7).collect()
    held = [(i, [math.floor(256 * float(np.float32(v))) for v in x]) for i, x, _ in rows]
    want = []
    for k, (i, x) in enumerate(held):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), j) for m, (j, y) in enumerate(held) if m != k)[:5]
            want += [(i, n + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, j) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_near_duplicates_with_one_id(spark):
    x, y = [1.0] + [0.0] * 7, [0.0, 1.0] + [0.0] * 6
    near = lambda v: [c + 0.01 for c in v]
    rows = [(1, x, 0), (1, y, 1), (2, near(x), 0), (3, near(y), 1), (7, x, 2), (7, y, 2), (8, near(x), 2), (6, near(y), 2), (7, x, 2)]
    got = [tuple(r) for r in embedding_dedup.near_duplicates(table(spark, rows)).collect()]
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 2, 7, True), (7, 1, 6, False), (8, 2, 7, False), (6, 1, 6, True), (7, 2, 7, True)]
    assert sorted(got) == sorted(want)
