"""The index from products to stored lists."""

import random

from basketry.plans import recommend, stored_lists
from basketry.plans.recommend import STORED
from basketry.sources import cells
from tests.builders import products


def lists(spark, rows):
    """Rows of (tenant, customer, products...)."""
    full = [(t, c, "home", k + 1, p, 1.0, "blended") for t, c, *ps in rows for k, p in enumerate(ps)]
    return spark.createDataFrame(full, STORED)


def keys(df):
    return sorted({(r.tenant_id, r.customer_id) for r in df.collect()})


def test_lists_go_with_an_updated_product(spark, tmp_path):
    roots = str(tmp_path / "lists"), str(tmp_path / "index")
    stored_lists.store_lists(lists(spark, [("A", "u", "p", "q"), ("A", "w", "q", "r"), ("B", "u", "p")]), *roots)
    stored_lists.store_lists(lists(spark, [("A", "u", "r", "s")]), *roots)  # no longer names p, the index still does
    assert stored_lists.drop_lists_naming(spark, products(spark, [("p", "A", "c")]), *roots) == 0
    assert stored_lists.drop_lists_naming(spark, products(spark, [("s", "A", "c"), ("none", "A", "c")]), *roots) == 1
    assert keys(cells.read(spark, roots[0], STORED)) == [("A", "w"), ("B", "u")]
    assert stored_lists.drop_lists_naming(spark, products(spark, [("p", "B", "c"), ("q", "A", "c")]), *roots) == 2
    assert cells.read(spark, roots[0], STORED).count() == 0


def test_only_cells_of_the_products_are_read_and_written(spark, tmp_path):
    roots = str(tmp_path / "lists"), str(tmp_path / "index")
    draw = random.Random(1)
    held = [(t, f"c{i}", *draw.sample([f"p{k}" for k in range(200)], 3)) for t in "AB" for i in range(150)]
    stored_lists.store_lists(lists(spark, held), *roots)
    before = {r.path: r for r in cells.entries(spark, roots[0]).collect()}
    changed = products(spark, [("p7", "A", "c")])
    index = cells.lookup(changed.withColumnRenamed("id", "product_id"), roots[1], stored_lists.NAMED, stored_lists.INDEX, stored_lists.BY)
    assert len(index.inputFiles()) == 1
    stale = [(t, c) for t, c, *ps in held if t == "A" and "p7" in ps]
    assert stored_lists.drop_lists_naming(spark, changed, *roots) == len(stale) > 0
    after = {r.path: r for r in cells.entries(spark, roots[0]).collect()}
    gone = set(before) - set(after)
    assert len(gone) <= len(stale) and all(before[p].tenant_id == "A" for p in gone)
    assert keys(cells.read(spark, roots[0], STORED)) == sorted({(t, c) for t, c, *_ in held} - set(stale))


def test_the_same_survivors_as_the_full_pass(spark, tmp_path):
    roots, plain = (str(tmp_path / "lists"), str(tmp_path / "index")), str(tmp_path / "plain")
    draw = random.Random(2)
    for step in range(4):
        recs = lists(spark, [(t, f"c{i}", *draw.sample("pqrstuv", draw.randrange(1, 4))) for t in "AB" for i in draw.sample(range(30), 10)])
        stored_lists.store_lists(recs, *roots)
        recommend.store_recommendations(recs, plain)
        changed = products(spark, [(draw.choice("pqrstuv"), draw.choice("AB"), "c")])
        stored_lists.drop_lists_naming(spark, changed, *roots)
        recommend.invalidate_stored(spark, plain, changed)
        if step == 2:
            assert stored_lists.compact_index(spark, roots[1], most=1) is not None
    from basketry.sources import tables

    got, want = cells.read(spark, roots[0], STORED), tables.current(spark, plain, STORED)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
