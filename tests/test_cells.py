"""Tables that rewrite only the cells a change touches."""

import random

import pytest

from basketry.sources import cells, tables
from basketry.sources.versions import versions

SCHEMA = "tenant STRING, k INT, v STRING"
KEYS, BY = ["tenant", "k"], ["tenant"]


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, root, version=None):
    return sorted((tuple(r) for r in cells.read(spark, root, SCHEMA, version).collect()), key=repr)


def files(spark, root, version=None):
    return {r.path: r for r in cells.entries(spark, root, version).collect()}


def test_upsert_of_few_keys_rewrites_their_cells_only(spark, tmp_path):
    root = str(tmp_path / "t")
    cells.upsert(made(spark, [(t, k, "old") for t in "ABC" for k in range(300)]), root, KEYS, SCHEMA, BY, 32)
    cells.upsert(made(spark, [("B", 7, "new"), ("B", 1000, "new")]), root, KEYS, SCHEMA, BY)
    one, two = files(spark, root, 1), files(spark, root, 2)
    assert len(one) == 96 and sum(r.rows for r in one.values()) == 900 and sum(r.rows for r in two.values()) == 901
    gone = set(one) - set(two)
    assert 1 <= len(gone) <= 2 and all(one[p].tenant == "B" for p in gone)
    assert len(set(one) & set(two)) == 96 - len(gone)
    want = {(t, k): "old" for t in "ABC" for k in range(300)} | {("B", 7): "new", ("B", 1000): "new"}
    assert stored(spark, root) == sorted(((*key, v) for key, v in want.items()), key=repr)
    assert stored(spark, root, 1) == sorted(((t, k, "old") for t in "ABC" for k in range(300)), key=repr)


def test_refreshing_a_tenant_carries_the_files_of_others(spark, tmp_path):
    root = str(tmp_path / "t")
    every = spark.createDataFrame([(t,) for t in "ABCD"], "tenant STRING")
    assert cells.replace(made(spark, [(t, k, "old") for t in "ABC" for k in range(50)]), root, every, KEYS, SCHEMA, BY, 4).count() == 0
    some = spark.createDataFrame([("B",), ("C",), ("D",)], "tenant STRING")
    lost = cells.replace(made(spark, [("B", 1, "new"), ("A", 1, "not asked for")]), root, some, KEYS, SCHEMA, BY, 4)
    assert [r.tenant for r in lost.collect()] == ["C"]
    one, two = files(spark, root, 1), files(spark, root, 2)
    assert {p for p, r in one.items() if r.tenant == "A"} == {p for p, r in two.items() if r.tenant == "A"}
    assert not any(p in two for p, r in one.items() if r.tenant != "A")
    assert stored(spark, root) == sorted([("A", k, "old") for k in range(50)] + [("B", 1, "new")], key=repr)


def test_crash_before_the_manifest_shows_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    cells.upsert(made(spark, [("A", 1, "old")]), root, KEYS, SCHEMA, BY)
    for step in ("_publish", "_complete"):
        with monkeypatch.context() as m:
            m.setattr(cells, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                cells.upsert(made(spark, [("A", 1, "new")]), root, KEYS, SCHEMA, BY)
        assert stored(spark, root) == [("A", 1, "old")]
        assert tables.current(spark, root, SCHEMA).count() == 1
    assert cells.upsert(made(spark, [("A", 1, "newer")]), root, KEYS, SCHEMA, BY) == 3
    assert stored(spark, root) == [("A", 1, "newer")]


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    cells.upsert(made(spark, [("A", 1, "old")]), root, KEYS, SCHEMA, BY)
    monkeypatch.setattr(cells, "next_version", lambda *a: 2)
    cells.upsert(made(spark, [("A", 1, "first")]), root, KEYS, SCHEMA, BY)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        cells.upsert(made(spark, [("A", 2, "second")]), root, KEYS, SCHEMA, BY)
    assert stored(spark, root) == [("A", 1, "first")]


def test_lookup_reads_the_cells_of_its_keys(spark, tmp_path):
    root = str(tmp_path / "t")
    cells.upsert(made(spark, [(t, k, "x") for t in "AB" for k in range(400)]), root, KEYS, SCHEMA, BY, 32)
    wanted = spark.createDataFrame([("A", 5, 0), ("B", 5, 0), ("B", 9999, 0), ("Z", 5, 0), ("A", 5, 1)], "tenant STRING, k LONG, more INT")
    got = cells.lookup(wanted, root, KEYS, SCHEMA, BY)
    assert sorted(map(tuple, got.collect())) == [("A", 5, "x"), ("B", 5, "x")]
    assert len(got.inputFiles()) <= 3 < len(files(spark, root))
    assert cells.lookup(wanted, str(tmp_path / "none"), KEYS, SCHEMA, BY).count() == 0


def test_a_plain_version_is_dealt_by_the_first_change(spark, tmp_path):
    for name, change in (
        ("u", lambda root: cells.upsert(made(spark, [("A", 1, "new")]), root, KEYS, SCHEMA, BY)),
        ("r", lambda root: cells.replace(made(spark, [("A", 1, "new")]), root, spark.createDataFrame([("A",), ("C",)], "tenant STRING"), KEYS, SCHEMA, BY)),
    ):
        root = str(tmp_path / name)
        tables.publish(made(spark, [("A", 1, "old"), ("B", 2, "old"), ("C", 3, "old")]), root)
        change(root)
        left = [("A", 1, "new"), ("B", 2, "old")] + ([("C", 3, "old")] if name == "u" else [])
        assert sorted(map(tuple, tables.current(spark, root, SCHEMA).collect())) == left


def test_old_versions_go_with_the_files_only_they_name(spark, tmp_path):
    root = str(tmp_path / "t")
    for k in range(4):
        cells.upsert(made(spark, [("A", k, "x"), ("B", 0, str(k))]), root, KEYS, SCHEMA, BY, 2)
    kept = set(files(spark, root)) | set(files(spark, root, 3))
    assert tables.prune_versions(spark, root, keep=2) == [1, 2]
    on_disk = {str(p.relative_to(root)) for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    assert on_disk == kept and versions(spark, root) == [3, 4]
    assert stored(spark, root) == [("A", 0, "x"), ("A", 1, "x"), ("A", 2, "x"), ("A", 3, "x"), ("B", 0, "3")]
    assert len(stored(spark, root, 3)) == 4


def test_nulls_and_odd_names_of_partitions(spark, tmp_path):
    root = str(tmp_path / "t")
    names = [None, "", "a/b", "a=b", "ü %", "null"]
    cells.upsert(made(spark, [(t, k, "old") for t in names for k in range(3)]), root, KEYS, SCHEMA, BY, 2)
    change = spark.createDataFrame([(None,), ("a/b",)], "tenant STRING")
    lost = cells.replace(made(spark, [("a/b", 9, "new")]), root, change, KEYS, SCHEMA, BY, 2)
    assert [r.tenant for r in lost.collect()] == [None]
    assert stored(spark, root) == sorted([(t, k, "old") for t in ("", "a=b", "ü %", "null") for k in range(3)] + [("a/b", 9, "new")], key=repr)


def test_empty_changes(spark, tmp_path):
    root = str(tmp_path / "t")
    assert cells.upsert(made(spark, []), root, KEYS, SCHEMA, BY) == 1
    assert stored(spark, root) == []
    cells.upsert(made(spark, [("A", 1, "x")]), root, KEYS, SCHEMA, BY)
    before = set(files(spark, root))
    cells.upsert(made(spark, []), root, KEYS, SCHEMA, BY)
    assert set(files(spark, root)) == before
    with pytest.raises(ValueError):
        cells.upsert(made(spark, []), root, ["k"], SCHEMA, BY)


def test_random_changes(spark, tmp_path):
    draw, root, want = random.Random(2), str(tmp_path / "t"), {}
    for step in range(8):
        rows = {(draw.choice("AB"), draw.randrange(30)): f"{step}" for _ in range(draw.choice([1, 10]))}
        if draw.random() < 0.3:
            tenant = draw.choice("AB")
            rows = {k: v for k, v in rows.items() if k[0] == tenant}
            cells.replace(made(spark, [(*k, v) for k, v in rows.items()]), root, spark.createDataFrame([(tenant,)], "tenant STRING"), KEYS, SCHEMA, BY, 4)
            want = {k: v for k, v in want.items() if k[0] != tenant}
        else:
            cells.upsert(made(spark, [(*k, v) for k, v in rows.items()]), root, KEYS, SCHEMA, BY, 4)
        want |= rows
    assert stored(spark, root) == sorted(((*k, v) for k, v in want.items()), key=repr)
