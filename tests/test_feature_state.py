"""Features from partial aggregates, against the full job."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from basketry import schemas
from basketry.plans import feature_state as state
from basketry.plans.customer_features import customer_features
from basketry.sources import cells, tables
from basketry.sources.versions import versions
from tests.builders import DAY, HOUR, MINUTE, events, products

MIDNIGHT = datetime(2026, 4, 20, tzinfo=timezone.utc)


def history(n=240, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        kind = draw.choice(["page_view", "product_view", "add_to_cart", "purchase", "click", "dismiss"])
        at = MIDNIGHT - draw.randrange(40) * DAY - draw.choice([0, 1, 23]) * HOUR - draw.randrange(90) * MINUTE - timedelta(microseconds=draw.randrange(3))
        money = draw.choice(["{}", '{"revenue": 0}', '{"revenue": 19.99}', '{"revenue": "0.001"}'])
        out.append((draw.choice("AB"), f"c{draw.randrange(6)}", kind, draw.choice([None, "p", "q", "r", "none"]), at, money))
    return out


def catalogue(spark):
    return products(spark, [("p", "A", "x"), ("q", "A", "y"), ("r", "B", "x"), ("p", "B", None)])


def flat(df):
    out = []
    for r in df.collect():
        d = r.asDict()
        d["category_affinity"] = sorted((d["category_affinity"] or {}).items())
        d.pop("updated_at")
        out.append(repr(sorted(d.items())))
    return sorted(out)


@pytest.fixture()
def roots(tmp_path):
    return str(tmp_path / "state"), str(tmp_path / "features")


@pytest.mark.parametrize("as_of", [MIDNIGHT, MIDNIGHT + DAY, "2026-04-10"])
def test_state_gives_the_features_of_the_events(spark, as_of):
    ev, pr = events(spark, history()), catalogue(spark)
    assert flat(state.features_of(state.folded(ev), pr, as_of)) == flat(customer_features(ev, pr, as_of))


def test_batches_in_any_order_with_late_and_repeated_ones(spark, roots):
    rows, pr = history(), catalogue(spark)
    draw = random.Random(4)
    part = [draw.randrange(4) for _ in rows]
    for k in (2, 0, 3, 1, 0, 2):
        state.add_events(events(spark, [r for r, p in zip(rows, part) if p == k]), pr, *roots, MIDNIGHT, f"batch {k}")
        if k == 3:
            assert state.compact_state(spark, roots[0], most=2) is not None
    want = customer_features(events(spark, rows), pr, MIDNIGHT)
    assert flat(state.features_of(cells.read(spark, roots[0], state.STATE), pr, MIDNIGHT)) == flat(want)
    assert flat(tables.current(spark, roots[1], schemas.CUSTOMER_FEATURES)) == flat(want)


def test_a_run_that_broke_off_is_repeated(spark, roots, monkeypatch):
    rows, pr = history(60), catalogue(spark)
    state.add_events(events(spark, rows[:40]), pr, *roots, MIDNIGHT, "one")
    with monkeypatch.context() as m:
        m.setattr(tables, "upsert_table", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            state.add_events(events(spark, rows[40:]), pr, *roots, MIDNIGHT, "two")
    assert versions(spark, roots[0]) == [1, 2] and versions(spark, roots[1]) == [1]
    state.add_events(events(spark, rows[40:]), pr, *roots, MIDNIGHT, "two")
    assert versions(spark, roots[0]) == [1, 2] and versions(spark, roots[1]) == [1, 2]
    assert flat(tables.current(spark, roots[1], schemas.CUSTOMER_FEATURES)) == flat(customer_features(events(spark, rows), pr, MIDNIGHT))


def test_only_customers_of_the_batch_are_made_and_only_their_cells_read(spark, roots, tmp_path):
    rows, pr = history(), catalogue(spark)
    folder = str(tmp_path / "events")
    events(spark, rows).write.parquet(folder)
    state.add_events(spark.read.parquet(folder), pr, *roots, MIDNIGHT, "one")
    before = {r.path for r in cells.entries(spark, roots[0]).collect() if r.path}
    new = events(spark, [("A", "c1", "purchase", "p", MIDNIGHT - MINUTE)])
    made = state.add_events(new, pr, *roots, MIDNIGHT, "two")
    assert [(r.tenant_id, r.customer_id) for r in made.collect()] == [("A", "c1")]
    after = {r.path: r for r in cells.entries(spark, roots[0]).collect() if r.path}
    assert before < set(after) and len(set(after) - before) == 1
    held = cells.lookup(new, roots[0], schemas.CUSTOMER, state.STATE, state.BY)
    assert 2 <= len(held.inputFiles()) < len(after) and not any(folder in f for f in held.inputFiles())


def test_compaction_keeps_the_names_of_batches(spark, roots):
    rows, pr = history(40), catalogue(spark)
    for k in range(4):
        state.add_events(events(spark, rows[k::4]), pr, *roots, MIDNIGHT, str(k))
    many = cells.entries(spark, roots[0]).where("path is not null").count()
    state.compact_state(spark, roots[0], most=1)
    few = cells.entries(spark, roots[0]).where("path is not null")
    assert few.count() < many and few.groupBy("__part", "__cell").count().where("count > 1").isEmpty()
    version = versions(spark, roots[0])[-1]
    assert state.compact_state(spark, roots[0], most=1) is None
    state.add_events(events(spark, rows[1::4]), pr, *roots, MIDNIGHT, "1")
    assert versions(spark, roots[0])[-1] == version


def test_no_events_and_no_midnight(spark, roots):
    made = state.add_events(events(spark, []), catalogue(spark), *roots, MIDNIGHT, "none")
    assert made.count() == 0
    with pytest.raises(ValueError):
        state.features_of(state.folded(events(spark, [])), catalogue(spark), MIDNIGHT + HOUR)
