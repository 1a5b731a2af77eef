"""Structured Streaming jobs: live rollup, event fan-out, scoring and triage.

Sinks are append-only tables with one folder per micro-batch.  A replayed batch
overwrites its own folder, and readers keep the last write per key, so restarts
after a failure neither lose nor double rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.operators import dashboards as d
from tidewatch.operators import flows as fl
from tidewatch.streaming import events as ev
from tidewatch.streaming.compaction import EPOCH_BATCHES, read_newest, write_newest

ROLLUP_KEYS = ("bucket", "tenant_id", "module", "threat_type")


# --- plumbing ---------------------------------------------------------------------------


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", trigger: dict | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None):
    """Start a query that writes every micro-batch into ``path/batch_id=N``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if prepare is None else prepare(batch)
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"processingTime": "15 minutes"})).start()


def last_write(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The table as of the last micro-batch: newest row per key."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")


# --- rollup -----------------------------------------------------------------------------


def rollup_stream(detections: DataFrame, late: str = "7 days") -> DataFrame:
    """Hourly counts and risks, kept open for late rows for ``late``."""
    return (
        detections.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour").alias("w"), "tenant_id", "module", "threat_type")
        .agg(F.count("*").alias("n"), F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("max_risk"))
        .select(F.col("w.start").alias("bucket"), "tenant_id", "module", "threat_type", "n", "avg_risk", "max_risk")
    )


def start_rollup(detections: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, epoch_batches: int = EPOCH_BATCHES):
    return write_newest(rollup_stream(detections), path, checkpoint, ROLLUP_KEYS, F.to_date("bucket"), "update", trigger, epoch_batches)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    return read_newest(spark, path, ROLLUP_KEYS)


def refresh_rollup(detections: DataFrame, path: str) -> None:
    """Full refresh; also the first fill.  Days are the partitions, as readers ask by time."""
    rollup = d.hourly_rollup(detections).withColumn("date", F.to_date("bucket"))
    spread = F.pmod(F.xxhash64("tenant_id", "threat_type"), F.lit(8))
    rollup.repartition("date", spread).write.mode("overwrite").partitionBy("date").parquet(path)


# --- events -----------------------------------------------------------------------------


def event_stream(detections: DataFrame, tenant_id=None) -> DataFrame:
    """Payloads of a detections stream, of one tenant when one is named."""
    scoped = detections if tenant_id is None else d.tenant_scope(detections, tenant_id)
    return ev.detection_payload(scoped)


def fan_out(payloads: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Hand every micro-batch of payloads to ``deliver(batch, batch_id)``; a replay has the same id."""
    writer = payloads.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(deliver)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def incident_changes(history: DataFrame) -> DataFrame:
    """Batch form: inserts of an incident and updates that change its status or severity.

    ``history`` is (id, ts, change_id, severity, status, ...); changes of one moment follow
    their change id.  The previous state is looked up
    inside (incident, day) and, for the first row of a day, from the last row of the
    days before: a long-lived incident is spread over its days.
    """
    from pyspark.sql import Window

    state = F.struct("severity", "status")
    dated = history.withColumns({"day": F.to_date("ts"), "state": state})
    last_of_day = dated.groupBy("id", "day").agg(F.max_by("state", F.struct("ts", "change_id")).alias("closing"))
    before = last_of_day.select("id", "day", F.lag("closing").over(Window.partitionBy("id").orderBy("day")).alias("opening"))
    inside = F.lag("state").over(Window.partitionBy("id", "day").orderBy("ts", "change_id"))
    known = dated.withColumn("previous", inside).join(before, ["id", "day"])
    previous = F.coalesce("previous", "opening")
    return known.filter(previous.isNull() | (previous != F.col("state"))).drop("day", "state", "previous", "opening")


_STATE = "severity string, status string"


def _announce(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("ts")
    last = tuple(state.get) if state.exists else None
    kept = []
    for i, now in enumerate(zip(rows["severity"], rows["status"])):
        if now != last:
            kept.append(i)
            last = now
    state.update(last)
    yield rows.iloc[kept]


def incident_change_stream(incidents: DataFrame) -> DataFrame:
    """Streaming form: the last (severity, status) of each incident is kept as state."""
    columns = ["id", "ts", "tenant_id", "kind", "severity", "entity_count", "status"]
    rows = incidents.select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy("id").applyInPandasWithState(_announce, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


# --- triage -----------------------------------------------------------------------------


def window_key(ts: Column, width: str) -> Column:
    return F.window(ts, width).getField("start")


def start_triage(log: DataFrame, path: str, checkpoint: str, width: str = "1 day", trigger: dict | None = None):
    """Rule triage per tumbling window.

    A micro-batch first stores its rows, then triages the windows it touched over all
    rows stored for them, so counts per source are those of the whole window and not
    of one batch.  Reports are rewritten by later batches (last write wins).
    """

    def triage(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("batch_key", window_key(F.col("ts"), width)).withColumn("day", F.to_date("batch_key"))
        keyed.write.mode("overwrite").partitionBy("day").parquet(f"{path}/rows/batch_id={batch_id}")
        stored = spark.read.parquet(f"{path}/rows").filter(F.col("batch_id") <= batch_id)
        mine = spark.read.parquet(f"{path}/rows/batch_id={batch_id}").select("day", "batch_key").distinct()
        touched = stored.join(mine, ["day", "batch_key"], "left_semi").drop("day", "batch_id")
        fl.flow_triage(touched, "batch_key").write.mode("overwrite").parquet(f"{path}/reports/batch_id={batch_id}")

    writer = log.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(triage)
    return writer.trigger(**(trigger or {"processingTime": "1 minute"})).start()


def read_triage(spark: SparkSession, path: str) -> DataFrame:
    return last_write(spark, f"{path}/reports", ("batch_key",))
