"""Folds over each key's rows in order of event time, on a stream: the same steps as plans.folding, with Spark's keyed state and event-time timers.

Rows wait in their key's state until the watermark has passed them, so that rows which come late, but not later than the stream waits for, are folded in their
place. Rows behind the watermark are dropped by Spark. The stream needs the RocksDB state store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sparkmere.operators import rerank, serving

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(StatefulProcessor):
    """Each key's waiting rows (at, row), and the state of its fold as JSON."""

    def __init__(self, columns: list[str], start: Callable[[], object], step: Callable, out: list[str]):
        self.columns, self.start, self.step, self.out = columns, start, step, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType()), StructField("row", StringType())]))
        self.state = handle.getValueState("state", StructType([StructField("value", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(int(r["at_ms"]), json.dumps([r[c] for c in self.columns])) for frame in rows for r in json.loads(frame.to_json(orient="records", double_precision=15))]
        self.waiting.appendList(came)
        for at in {at for at, _ in came}:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = list(self.waiting.get())
        ready = sorted((tuple(json.loads(row)) for at, row in waiting if at <= until), key=lambda r: r[1:3])  # by time, then by the column that breaks ties
        if not ready:
            return
        left = [(at, row) for at, row in waiting if at > until]
        self.waiting.put(left) if left else self.waiting.clear()
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.start()
        found = []
        for row in ready:
            state, values = self.step(tuple(state) if isinstance(state, list) else state, row)
            found.append((*row, *values))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(found, columns=[*self.columns, *self.out])


def folded_stream(events: DataFrame, late: str, start: Callable[[], object], step: Callable, out: dict[str, str], more: tuple[str, ...] = ()) -> DataFrame:
    """key, at, tie, the columns more and those of out (name -> type) for each row of a stream (key, ts timestamp, tie, more), once its watermark has passed.

    step(state, row) -> (state, values) gets rows (key, at in seconds, tie, *more) in order of at and tie; states are what JSON can hold.
    """
    columns = ["key", "at", "tie", *more]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    timed = timed.withColumn("at", F.unix_micros("ts") / 1e6).withColumn("at_ms", F.unix_millis("ts"))
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in columns), *(f"{n} {k}" for n, k in out.items())])
    rows = timed.select(*columns, "ts", "at_ms").groupBy("key")
    return rows.transformWithStateInPandas(Fold(columns, start, step, list(out)), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def limited_stream(events: DataFrame, seconds: int, limit: int, late: str) -> DataFrame:
    """key, at, event_id, allowed: the exact limiter of operators.rerank on a stream (key, ts, event_id)."""
    own = events.select("key", "ts", F.col("event_id").alias("tie"))
    step = rerank.limiter(seconds, limit)
    return folded_stream(own, late, lambda: (None, 0, 0), lambda state, row: step(state, (row[0], row[2], row[1])), {"allowed": "boolean"}).withColumnRenamed("tie", "event_id")


def breaker_stream(calls: DataFrame, late: str, failures: int = serving.FAILURES, cooldown: float = serving.COOLDOWN_SECONDS) -> DataFrame:
    """key, at, failed, state: the circuit breaker of operators.serving on a stream (key, ts, failed)."""
    own = calls.select("key", "ts", F.col("failed").alias("tie"))
    return folded_stream(own, late, lambda: (0, None), serving.breaker_step(failures, cooldown), {"state": "string"}).withColumnRenamed("tie", "failed")
