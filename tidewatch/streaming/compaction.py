"""Versioned tables of a stream whose readers don't read every version ever written.

A micro-batch is written to ``rows/epoch=E/batch_id=N``, where an epoch is a fixed number
of batches.  Once an epoch is over, the newest row per key is written anew for the days
that the epoch touched (``days/<part>/day=D``), and a single file of the manifest names the
new parts.  A reader takes each day's newest part and the rows of the epochs since, so its
cost depends on the table and on two epochs at most, not on how many batches there were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_BATCHES = 50
_MANIFEST = "epoch bigint, day string, part string"


def _read(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.option("recursiveFileLookup", schema is not None).parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _manifest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The last epoch that is compacted (-1: none) and, per day, its newest part."""
    rows = _read(spark, f"{path}/manifest", _MANIFEST)
    if rows is None:
        return -1, None
    last = rows.agg(F.max("epoch")).first()[0]
    newest = rows.filter("day IS NOT NULL").groupBy("day").agg(F.max(F.struct("epoch", "part"))["part"].alias("part"))
    return (-1 if last is None else last), newest


def _newest(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v")).select(*keys, "v.*")


def _parts(spark: SparkSession, path: str, days: DataFrame | None) -> DataFrame | None:
    """Rows of the named days' newest parts; one short name per day passes the driver."""
    found = [] if days is None else [f"{path}/days/{row['part']}/day={row['day']}" for row in days.toLocalIterator()]
    return spark.read.parquet(*sorted(found)) if found else None


def _epochs(spark: SparkSession, path: str, first: int) -> list[DataFrame]:
    """Rows of the epoch ``first`` and of those after it, as far as there are any."""
    found = []
    while (rows := _read(spark, f"{path}/rows/epoch={first + len(found)}")) is not None:
        found.append(rows.withColumn("batch_id", F.col("batch_id").cast("long")))
    return found


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    whole = None
    for part in parts:
        if part is not None:
            whole = part if whole is None else whole.unionByName(part)
    return whole


def read_newest(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The table as of the last micro-batch: the newest row per key."""
    last, days = _manifest(spark, path)
    rows = _union([_parts(spark, path, days), *_epochs(spark, path, last + 1)])
    if rows is None:
        raise ValueError(f"no micro-batch has been written to {path}")
    return _newest(rows, keys).drop("batch_id")


def compact(spark: SparkSession, path: str, keys: tuple[str, ...], day: Column, epoch: int) -> None:
    """Fold an epoch that is over into the days it touched; done twice it answers alike.

    The manifest's file appears by one rename after the parts are whole.  Parts that it
    no longer names are left for the owner to remove.
    """
    last, days = _manifest(spark, path)
    if epoch <= last:
        return
    fresh = _read(spark, f"{path}/rows/epoch={epoch}")
    touched = None
    if fresh is not None:
        fresh = fresh.withColumn("batch_id", F.col("batch_id").cast("long"))
        touched = fresh.select(F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("none")).alias("day")).distinct()
        before = _parts(spark, path, days.join(touched, "day", "left_semi")) if days is not None else None
        part = f"epoch-{epoch}-{uuid.uuid4().hex}"
        folded = _newest(_union([before, fresh]), keys).withColumn("day", F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("none")))
        salt = F.pmod(F.xxhash64(*keys), F.lit(8))
        folded.repartition("day", salt).write.partitionBy("day").parquet(f"{path}/days/{part}")
        named = touched.select(F.lit(epoch).cast("long").alias("epoch"), "day", F.lit(part).alias("part"))
    else:
        named = spark.createDataFrame([], _MANIFEST)
    end = spark.createDataFrame([(epoch, None, None)], _MANIFEST)
    named.unionByName(end).coalesce(1).write.parquet(f"{path}/manifest/{uuid.uuid4().hex}")


def write_newest(
    stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...], day: Column, mode: str = "update", trigger: dict | None = None, epoch_batches: int = EPOCH_BATCHES,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
):
    """Start a query that writes each micro-batch, and folds an epoch at the first batch after it.

    A replayed batch overwrites its own folder: its epoch isn't compacted before the next
    epoch's first batch, which comes after it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        epoch = batch_id // epoch_batches
        rows = batch if prepare is None else prepare(batch)
        rows.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}/batch_id={batch_id}")
        if epoch:
            compact(batch.sparkSession, path, keys, day, epoch - 1)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return writer.trigger(**(trigger or {"processingTime": "15 minutes"})).start()
