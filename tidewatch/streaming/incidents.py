"""Incident events in event-time order, whatever order and batches their rows arrive in.

Rows of an incident wait in state until the watermark has passed them; a timer then takes
them in order of (time, change id), announces those that differ from the state before, and
sleeps until the next row is due.  So a late row within the allowance changes nothing in
the answer, and a replayed batch starts from the state it started from before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidewatch.streaming import events as ev
from tidewatch.streaming.jobs import write_batches

_WAITING = "at bigint, change_id bigint, severity string, status string, payload string"
_LAST = "severity string, status string, at bigint"
_COLUMNS = ["at", "change_id", "severity", "status", "payload"]
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Changes(StatefulProcessor):
    """State per incident: the rows that wait, the state and time of the last one, and timers.

    With ``forget_ms`` an incident without a row for longer is forgotten; its next row is
    announced as a first one, whatever batches the rows came in.
    """

    def __init__(self, forget_ms: int | None = None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.last = handle.getValueState("last", _LAST)

    def _silent(self, last: int, now: int) -> bool:
        return self.forget_ms is not None and now - last > 1000 * self.forget_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            text = lambda name: [None if pd.isna(v) else v for v in frame[name]]
            found = list(zip(frame["at"].tolist(), frame["change_id"].tolist(), text("severity"), text("status"), text("payload")))
            self.waiting.appendList(found)
            self.handle.registerTimer(-(-min(found)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        final = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due, later = [r for r in rows if r[0] <= final], [r for r in rows if r[0] > final]
        last = tuple(self.last.get()) if self.last.exists() else None
        announced = []
        for row in due:
            if last is None or row[2:4] != last[:2] or self._silent(last[2], row[0]):
                announced.append(row)
            last = (*row[2:4], row[0])
        if due:
            self.last.update(last)
            self.waiting.put(later) if later else self.waiting.clear()
            if self.forget_ms is not None:
                self.handle.registerTimer(last[2] // 1000 + self.forget_ms + 1)
        elif last is not None and self._silent(last[2], final):
            self.last.clear()
        if later:
            self.handle.registerTimer(-(-later[0][0] // 1000))
        if announced:
            yield pd.DataFrame(announced, columns=_COLUMNS).assign(id=key[0])[["id", *_COLUMNS]]


def incident_events(incidents: DataFrame, late: str = "1 hour", forget_ms: int | None = None) -> DataFrame:
    """(id, at, change_id, severity, status, payload) for each first or changed state of an incident.

    ``incidents`` is a stream of (id, ts, change_id, tenant_id, kind, severity, entity_count,
    status) with whole-number ids; ``at`` is microseconds since 1970.  Rows without an id or
    a time can't be placed and are left out.
    """
    placed = incidents.filter("id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = placed.select(
        F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("at"), F.coalesce(F.col("change_id").cast("long"), F.lit(-1).cast("long")).alias("change_id"),
        "severity", "status", ev.incident_json().alias("payload"))
    return rows.groupBy("id").transformWithStateInPandas(
        statefulProcessor=Changes(forget_ms), outputStructType=f"id bigint, {_WAITING}", outputMode="Append", timeMode="EventTime")


def start_incident_events(incidents: DataFrame, path: str, checkpoint: str, late: str = "1 hour", forget_ms: int | None = None, trigger: dict | None = None):
    """Write the events batch by batch; timers need the RocksDB state store, which this query alone takes."""
    spark = incidents.sparkSession
    before = spark.conf.get(_PROVIDER[0])
    spark.conf.set(*_PROVIDER)
    try:
        return write_batches(incident_events(incidents, late, forget_ms), path, checkpoint, "append", trigger)
    finally:
        spark.conf.set(_PROVIDER[0], before)
