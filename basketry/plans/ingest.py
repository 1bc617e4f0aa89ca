"""Store request bodies as events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.ingest import deduplicate, ingest_events
from basketry.session import materialize
from basketry.sources.lake import stored_ids, write_events
from basketry.sources.tables import append_new


def ingest_to_lake(
    raw: DataFrame, lake_path: str, rejected_path: str, uuid_ids: bool = True
) -> None:
    """Add the good bodies' events to the lake and list the rejected bodies.

    Event ids come from the bodies, so a replay, or a retry after a failure between the two
    writes, adds nothing that is stored: events are compared with those of the days they
    fall on, rejected bodies with those listed. One writer per lake at a time.
    """
    accepted, rejected = ingest_events(raw, uuid_ids)
    accepted = materialize(deduplicate(accepted), "accepted")
    first, last = accepted.agg(F.min("timestamp"), F.max("timestamp")).first()
    if first is not None:
        known = stored_ids(raw.sparkSession, lake_path, first, last)
        write_events(accepted.join(known, ["tenant_id", "id"], "left_anti"), lake_path)
    append_new(rejected, rejected_path, ["batch_id", "tenant_id"])
