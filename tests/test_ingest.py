import json
import uuid

import pytest

from basketry.operators import ingest
from basketry.schemas import RAW_BATCHES
from basketry.sources import lake
from tests.builders import DAY, NOW, events, rows

TENANT = str(uuid.UUID(int=7))
PRODUCT = "00000000-0000-4000-8000-00000000beef"


def event(**change):
    base = {
        "customer_id": "lee", "event_type": "product_view", "product_id": PRODUCT,
        "properties": {"page": 2}, "timestamp": "2025-11-02T10:15:00Z",
    }
    base.update(change)
    return {k: v for k, v in base.items() if v != "DROP"}


def body(*items):
    return json.dumps({"events": list(items)})


def run(spark, *bodies, tenant=TENANT, **options):
    raw = spark.createDataFrame([(f"b{i}", tenant, b) for i, b in enumerate(bodies)], RAW_BATCHES)
    return ingest.ingest_events(raw, **options)


def test_good_batch(spark):
    accepted, rejected = run(spark, body(event(), event(product_id=None, properties="DROP")))
    assert rejected.count() == 0
    got = accepted.orderBy("product_id").collect()
    assert [r.product_id for r in got] == [None, PRODUCT]
    assert [json.loads(r.properties) for r in got] == [{}, {"page": 2}]
    assert got[0].timestamp.isoformat() == "2025-11-02T10:15:00"
    assert len({r.id for r in got}) == 2


def test_replay_gives_equal_ids(spark):
    first, _ = run(spark, body(event(), event()))
    again, _ = run(spark, body(event(), event()))
    assert rows(first, "id") == rows(again, "id")
    assert ingest.deduplicate(first.unionByName(again)).count() == 2


@pytest.mark.parametrize("change,reason", [
    ({"customer_id": "DROP"}, "bad customer_id"),
    ({"customer_id": 5}, "bad customer_id"),
    ({"customer_id": ""}, "bad customer_id"),
    ({"event_type": None}, "bad event_type"),
    ({"product_id": "no-uuid"}, "bad product_id"),
    ({"product_id": ""}, "bad product_id"),
    ({"product_id": 12}, "bad product_id"),
    ({"properties": None}, "bad properties"),
    ({"properties": [1]}, "bad properties"),
    ({"timestamp": "yesterday-ish"}, "bad timestamp"),
    ({"timestamp": "DROP"}, "bad timestamp"),
])
def test_one_bad_event_rejects_the_batch(spark, change, reason):
    accepted, rejected = run(spark, body(event(), event(**change)), body(event()))
    assert rows(rejected, "batch_id", "reason") == [("b0", reason)]
    assert accepted.count() == 1


@pytest.mark.parametrize("text,reason", [
    ("not json", "not json"), (None, "not json"), ('{"events": 3}', "events missing"),
    ("{}", "events missing"),
])
def test_bad_bodies(spark, text, reason):
    _, rejected = run(spark, text)
    assert rows(rejected, "reason") == [(reason,)]


def test_batch_size_limit(spark):
    accepted, rejected = run(spark, body(*[event()] * 1000), body(*[event()] * 1001))
    assert rows(rejected, "batch_id", "reason") == [("b1", "too many events")]
    assert accepted.count() == 1000


def test_empty_batch_is_fine(spark):
    accepted, rejected = run(spark, body())
    assert (accepted.count(), rejected.count()) == (0, 0)


def test_tenant_must_be_a_uuid_unless_told_otherwise(spark):
    _, rejected = run(spark, body(event()), tenant="t1")
    assert rows(rejected, "reason") == [("tenant_id",)]
    accepted, _ = run(spark, body(event(product_id="12")), tenant="t1", uuid_ids=False)
    assert rows(accepted, "product_id") == [("12",)]


@pytest.mark.parametrize("given,expected", [
    (1_762_078_500, "2025-11-02T10:15:00"),
    (1_762_078_500_500, "2025-11-02T10:15:00.500000"),
    ("2025-11-02T12:15:00+02:00", "2025-11-02T10:15:00"),
    ("2025-11-02T10:15:00", "2025-11-02T10:15:00"),
])
def test_written_forms_of_time(spark, given, expected):
    accepted, _ = run(spark, body(event(timestamp=given)))
    assert accepted.first().timestamp.isoformat() == expected


def test_lake_round_trip_and_pruning(spark, tmp_path):
    path = str(tmp_path / "lake")
    ev = events(spark, [("A", "c", "click", None, NOW - n * DAY) for n in range(4)]
                + [("B/x", "c", "purchase", "p", NOW)])
    lake.write_events(ev, path)
    assert rows(lake.read_events(spark, path), *ev.columns) == rows(ev, *ev.columns)
    part = lake.read_events(spark, path, tenant_id="A", since=NOW - DAY)
    assert part.count() == 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "tenant_id" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "event_date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(timestamp" in plan


def test_tsv(spark, tmp_path):
    file = tmp_path / "events.tsv"
    file.write_text(
        'A\tc\tclick\t\t"{""a"": ""x\ty""}"\t2025-11-02 10:15:00+00:00\n', encoding="utf-8"
    )
    row = lake.read_events_tsv(spark, str(file)).first()
    assert row.product_id is None and row.properties == '{"a": "x\ty"}'
    assert row.timestamp.isoformat() == "2025-11-02T10:15:00"


def test_batch_files(spark, tmp_path):
    file = tmp_path / "batches.json"
    file.write_text(json.dumps({"batch_id": "b", "tenant_id": TENANT, "body": body(event())}))
    accepted, _ = ingest.ingest_events(lake.read_batches(spark, str(file)))
    assert accepted.count() == 1


@pytest.mark.parametrize("spelled", [
    PRODUCT.upper(), PRODUCT.replace("-", ""), "{" + PRODUCT + "}", "urn:uuid:" + PRODUCT,
    "URN:UUID:{" + PRODUCT.upper().replace("-", "") + "}",
])
def test_ids_come_out_in_one_form(spark, spelled):
    accepted, rejected = run(spark, body(event(product_id=spelled)), tenant=TENANT.upper())
    assert rejected.count() == 0
    assert rows(accepted, "tenant_id", "product_id") == [(TENANT, PRODUCT)]
