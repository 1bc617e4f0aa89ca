"""The helpers that the operators share, against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import _bloom, _text
from basketry.llm._components import connected_components, local_components
from basketry.llm._elias_fano import EliasFano, encode


def find_roots(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {x: root(x) for x in parent}


def test_tokens_and_hashes_do_not_depend_on_place():
    texts = [None, "", "  ", "one Two\tTHREE", "three", "é x\x0b\x0cé", "two one", ""]
    column = pa.array(texts)
    found = []
    for i, j, data, at in _text.runs(column, 8):
        t = _text.tokens(data, at)
        codes = _text.hashes(t.sums, t.start, t.end)
        for r in range(j - i):
            found.append([(bytes(data[a:b]), c) for a, b, c in list(zip(t.start, t.end, codes))[t.first[r]:t.first[r + 1]]])
    words = [[w for w, _ in row] for row in found]
    assert words == [(x or "").encode().split() for x in texts]
    by_word = {}
    for row in found:
        for w, c in row:
            assert by_word.setdefault(w.lower(), c) == c
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_of_short_rows():
    words = np.arange(1, 12, dtype=np.uint64)
    codes, begin = _text.shingles(words, np.array([0, 0, 1, 3, 11]), 5)
    assert np.diff(begin).tolist() == [0, 1, 1, 4]
    assert len(set(codes.tolist())) == 6


@pytest.mark.parametrize("n,top", [(1, 0), (1, 7), (5, 0), (70, 40), (1000, 10**6), (3000, 10**12), (3, 2**40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top + 1, n))
    held = EliasFano(np.frombuffer(encode(values), np.uint64))
    assert held.get(np.arange(n)).tolist() == values.tolist()
    asked = np.concatenate([values, rng.integers(0, top + 2, 200)])
    place, exact = held.find(asked, np.zeros(len(asked), int), np.full(len(asked), n))
    assert place.tolist() == np.searchsorted(values, asked).tolist()
    assert exact.tolist() == np.isin(asked, values).tolist()


def test_twice_seen_is_never_missed():
    rng = np.random.default_rng(3)
    once = rng.integers(0, 2**63, 4000).astype(np.uint64)
    seen = np.concatenate([once, once[:500]])
    for bits in (1 << 10, 1 << 17):
        filters = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        _bloom.sightings(seen, filters, run=700)
        assert _bloom.has(filters[1], once[:500]).all()
    assert _bloom.has(filters[1], once[500:]).mean() < 0.05


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300) * 5, rng.randrange(300) * 5) for _ in range(260)]
    edges += [(2000 + i, 2001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 60)]
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.component for r in connected_components(table).collect()}
    want = find_roots([e for e in edges if e[0] != e[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert local_components(4, np.array([3, 1]), np.array([1, 2])).tolist() == [0, 1, 1, 1]


def test_components_of_large_ids(spark):
    top = (1 << 63) - 1
    edges = [(top - i, top - i - 1) for i in range(6)] + [(-top + i, -top + i + 1) for i in range(0, 6, 2)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    root = find_roots(edges)
    assert dict(map(tuple, got.collect())) == {x: root.get(x, x) for e in edges for x in e}
