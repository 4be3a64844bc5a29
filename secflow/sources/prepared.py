"""Normalised events as the input of detection, features, threat intelligence and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from secflow.schema import EVENT_COLUMNS


def referenced(events: DataFrame) -> DataFrame:
    """``EVENT_SCHEMA`` with a reference of its own for every event; columns beyond the schema stay.

    Sources repeat their ids (a log's event number, a constant), so joins on them land on foreign hosts. Here
    ``event_id`` becomes a 64-bit fingerprint of everything the record says, and the source's own id moves to
    ``source_event_id``. Records that are equal in every field are one event and share the reference.
    """
    as_text = [F.to_json(F.array_sort(F.map_entries(c))) if c in ("properties", "hashes") else F.col(c).cast("string")
               for c in EVENT_COLUMNS if c != "tags"]
    marked = [F.coalesce(x, F.lit("\0")) for x in as_text]
    return events.withColumn("source_event_id", F.col("event_id")).withColumn("event_id", F.xxhash64(*marked))
