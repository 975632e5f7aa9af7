"""Registry of keyed sessions: opened, used, and gone when closed. The same aggregate serves tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registry(events: DataFrame) -> DataFrame:
    """key, opened_ms, last_ms, uses, closed of the events (key, event_id, ms, kind: 'open', 'use' or 'close').

    The last event by (ms, event_id) decides: after a close the key is not registered until it is opened or used again.
    Partial aggregates combine map-side, so a busy key is no hot task; on a stream, write in update mode.
    """
    at = F.struct("ms", "event_id")
    return events.groupBy("key").agg(F.min("ms").alias("opened_ms"), F.max("ms").alias("last_ms"), F.count("*").alias("uses"), (F.max_by("kind", at) == "close").alias("closed"))


def registered(events: DataFrame) -> DataFrame:
    """The keys that are registered after all events."""
    return registry(events).where("NOT closed").drop("closed")
