"""Requests that must answer in time, as a stream with timers, and progress as it happens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener


class Deadline(StatefulProcessor):
    """A request's chunks (key, done) until it is done; if its timer fires first, it is aborted and its state dropped."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "chunks long, closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        chunks, closed = self.seen.get() if self.seen.exists() else (0, False)
        if not chunks and not closed:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout)
        for part in rows:
            if not closed:
                chunks += len(part)
                closed = bool(part["done"].any())
                if closed:
                    yield pd.DataFrame({"key": [key[0]], "outcome": ["done"], "chunks": [chunks]})
        self.seen.update((chunks, closed))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        chunks, closed = self.seen.get() if self.seen.exists() else (0, True)
        self.seen.clear()
        if not closed:
            yield pd.DataFrame({"key": [key[0]], "outcome": ["timeout"], "chunks": [chunks]})

    def close(self) -> None:
        pass


def with_deadline(chunks: DataFrame, timeout_ms: int) -> DataFrame:
    """key, outcome ('done' or 'timeout'), chunks: one row a request. Needs the RocksDB state store."""
    return chunks.groupBy("key").transformWithStateInPandas(statefulProcessor=Deadline(timeout_ms), outputStructType="key long, outcome string, chunks long", outputMode="Append", timeMode="ProcessingTime")


class Progress(StreamingQueryListener):
    """Calls ``on`` with (event, rows) when a query starts, moves on, idles or ends."""

    def __init__(self, on):
        self.on = on

    def onQueryStarted(self, event) -> None:
        self.on("started", 0)

    def onQueryProgress(self, event) -> None:
        self.on("progress", event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.on("idle", 0)

    def onQueryTerminated(self, event) -> None:
        self.on("terminated", 0)
