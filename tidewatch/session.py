"""Session settings and the two plan helpers every module leans on."""

from __future__ import annotations

import itertools
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a lookup side is joined by shuffle instead of broadcast.
BROADCAST_ROW_BOUND = 100_000


# Python call sites of every column operation: a cost per operation on the driver.
_NO_CALL_SITES = ("spark.python.sql.dataFrameDebugging.enabled", "false")


def build_session(app: str = "tidewatch", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the jobs expect; cluster defaults win where they are set."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(*_NO_CALL_SITES)
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    session = builder.getOrCreate()
    prepare(session)
    return session


def prepare(spark: SparkSession) -> None:
    """Settings a session from elsewhere needs too: all timestamps in the data model are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    _ship_package(spark)


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Python workers import this package; executors get it as a zip, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(), os.path.basename(package)), "zip", os.path.dirname(package), os.path.basename(package)
        )
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def spread_small_scan(df: DataFrame, rows_per_core: int = 50_000) -> DataFrame:
    """Give every core a share of a small input whose rows are costly to work on.

    A file of a few megabytes is one split, hence one task.  An input with splits or
    rows enough for every core is returned untouched, without a shuffle; the count stops
    as soon as that is clear.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    bound = cores * rows_per_core
    return df.repartition(cores) if df.limit(bound + 1).count() <= bound else df


_own_folders: dict[str, str] = {}  # of sessions that name none, by application


def shared_folder(spark: SparkSession) -> str:
    """The folder of the cluster for checkpoints and intermediate tables.

    It is the session's ``spark.checkpoint.dir``.  Only when that is unset and the master
    is ``local`` (tests, a laptop) a folder of our own is used, one per application; a cluster
    must name one.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or _own_folders.get(sc.applicationId) or sc.getCheckpointDir()
    if configured is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = _own_folders[sc.applicationId] = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"tidewatch-{uuid.uuid4().hex}")
        sc.setCheckpointDir(configured)
    return configured


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """What runs inside has no stage with a method that the JVM would interpret.

    HotSpot never compiles a method above 8,000 bytes of code, and a stage of thirty features makes
    a larger one; operators by themselves have smaller methods.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def set_checkpoint_folder(spark: SparkSession) -> None:
    """Reliable checkpoints go to the shared folder, unless the session names another."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    set_checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(parts: Iterator[tuple[DataFrame, Broadcast]], name: str) -> DataFrame | None:
    """The union of parts that each read a broadcast of their own; None without parts.

    A single part stays a plan.  Of several, each is written in the shared folder and its
    broadcast destroyed before the one after the next is made, so that the driver holds two
    broadcasts and one read, however many parts there are.
    """
    ahead = list(itertools.islice(parts, 2))
    if len(ahead) < 2:
        return ahead[0][0] if ahead else None
    spark, schema = ahead[0][0].sparkSession, ahead[0][0].schema
    path = scratch_path(spark, name)
    while ahead:
        part, shared = ahead.pop(0)
        part.write.mode("append").parquet(path)
        shared.destroy()
        ahead += itertools.islice(parts, 1)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(df: DataFrame, bound: int = BROADCAST_ROW_BOUND) -> DataFrame:
    """Broadcast hint only when a row count proves the side small.

    ``limit(bound + 1)`` stops the count early on a large side, which then goes
    through Spark's own shuffle join with adaptive skew handling.
    """
    if df.limit(bound + 1).count() <= bound:
        return F.broadcast(df)
    return df
