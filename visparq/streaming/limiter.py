"""Keyed sliding-window limiter, as a stream and as a batch fold, and what else keeps state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from visparq import schema as S


class Limiter(StatefulProcessor):
    """Keeps the times of accepted events within the window; a rejected event is not recorded.

    State is at most ``limit`` times a key, and expires with the window.
    """

    def __init__(self, window_ms: int = S.UPLOAD_WINDOW_MS, limit: int = S.UPLOAD_LIMIT):
        self.window, self.limit = window_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "ms long", ttlDurationMs=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.times.get()]
        events = pd.concat(list(rows)).sort_values(["ms", "event_id"], kind="stable")
        accepted = []
        for ms in events["ms"]:
            kept = [t for t in kept if ms - t < self.window]
            accepted.append(len(kept) < self.limit)
            if accepted[-1]:
                kept.append(int(ms))
        self.times.put([(t,) for t in kept])
        yield pd.DataFrame({"key": key[0], "event_id": events["event_id"], "ms": events["ms"], "accepted": accepted})

    def close(self) -> None:
        pass


def limit_stream(events: DataFrame, window_ms: int = S.UPLOAD_WINDOW_MS, limit: int = S.UPLOAD_LIMIT) -> DataFrame:
    """events: key, event_id, ms; adds ``accepted``. Needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=Limiter(window_ms, limit), outputStructType="key long, event_id long, ms long, accepted boolean", outputMode="Append", timeMode="None")


def limit_batch(events: DataFrame, window_ms: int = S.UPLOAD_WINDOW_MS, limit: int = S.UPLOAD_LIMIT) -> DataFrame:
    """The same decisions over a table: an ordered pass over each key that holds one key's window, not its history."""

    def run(batches: Iterator) -> Iterator:
        key, kept = object(), []
        for b in batches:
            out = []
            for k, ms in zip(b.column("key").to_pylist(), b.column("ms").to_pylist(), strict=True):
                if k != key:
                    key, kept = k, []
                kept = [t for t in kept if ms - t < window_ms]
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(ms)
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("event_id"), b.column("ms"), pa.array(out, pa.bool_())], names=["key", "event_id", "ms", "accepted"])

    dealt = events.select("key", "event_id", "ms").repartition("key").sortWithinPartitions("key", "ms", "event_id")
    return dealt.mapInArrow(run, "key long, event_id long, ms long, accepted boolean")


def expired(files: DataFrame, now_ms: int, ttl_ms: int = S.TTL_MS) -> DataFrame:
    """Files whose last change is older than the time to live."""
    return files.where(F.lit(now_ms) - F.col("mtime_ms") > ttl_ms)


def admit(requests: DataFrame, queue: int = 20) -> DataFrame:
    """Bounded first-in-first-out admission to one slot: requests (slot, request_id, ms, busy_ms) get started_ms, or are
    rejected when ``queue`` wait. One ordered fold a slot; a slot's waiting line is bounded by the queue."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        slot, ends = object(), []
        for b in batches:
            starts = []
            for s, ms, busy in zip(b.column("slot").to_pylist(), b.column("ms").to_pylist(), b.column("busy_ms").to_pylist(), strict=True):
                if s != slot:
                    slot, ends = s, []
                ends = [e for e in ends if e > ms]
                if len(ends) > queue:
                    starts.append(None)
                else:
                    starts.append(max([ms, *ends[-1:]]))
                    ends.append(starts[-1] + busy)
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("request_id"), pa.array(starts, pa.int64())], names=["slot", "request_id", "started_ms"])

    return requests.select("slot", "request_id", "ms", "busy_ms").repartition("slot").sortWithinPartitions("slot", "ms", "request_id").mapInArrow(run, "slot long, request_id long, started_ms long")


def upload_status(size: F.Column, declared: F.Column, content: F.Column, limited: F.Column, most: int = 20 * 1024 * 1024) -> F.Column:
    """Status of an upload: the first reason in order, else 200."""
    from visparq.functions import guards

    return F.when(limited, 429).when(size == 0, 400).when(size > most, 413).when(~F.lower(declared).isin(guards.DECLARED), 415).when(~guards.supported(content), 422).otherwise(200)
