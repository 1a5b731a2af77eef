"""Tables that take each keyed row once, however often a batch is written.

A stored table is a folder with ``data/<part>`` (Parquet, one folder per attempt to write
a batch) and ``commits/<batch>`` (one row that names the part that counts).  The row
appears by the rename of a single file after the part is whole, so readers see a batch
as a whole or not at all, and parts of failed attempts are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.operators.quality import insert_if_absent
from tidewatch.session import cut_lineage

_COMMIT = "batch string, part string, columns string"


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, part, columns): one row per committed batch, also when two writers raced for it."""
    try:
        rows = spark.read.schema(_COMMIT).option("recursiveFileLookup", True).parquet(f"{folder}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _COMMIT)
    return rows.groupBy("batch").agg(F.min(F.struct("part", "columns")).alias("kept")).select("batch", "kept.*")


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """All committed rows; None before the first commit."""
    found = sorted((row["part"], row["columns"]) for row in commits(spark, folder).toLocalIterator())
    if not found:
        return None
    columns = StructType.fromJson(json.loads(found[0][1]))
    paths = [f"{folder}/data/{part}" for part, _ in found]
    return spark.read.schema(columns).option("basePath", f"{folder}/data").parquet(*paths).select(*columns.names)


def insert_batch(
    rows: DataFrame,
    folder: str,
    batch: str,
    keys: Sequence[str],
    order_by: Sequence[str],
    write: Callable[[DataFrame, str], None] | None = None,
    pruned_by: str | None = None,
) -> bool:
    """Add the rows whose key the table doesn't hold yet, as one batch; False if it is there already.

    Of several rows of one key in the batch the first by ``order_by`` and then by all
    columns stays.  Null parts of a key equal each other.  ``pruned_by`` names a key
    column that rises with time: only stored rows within the batch's span of it are
    compared.  Batches are written one at a time: two writers that add the same key in
    different batches at the same moment would both keep it.
    """
    spark = rows.sparkSession
    if commits(spark, folder).filter(F.col("batch") == batch).limit(1).count():
        return False
    there = stored(spark, folder)
    if there is None:
        there = rows.limit(0)
    elif pruned_by:
        rows = cut_lineage(rows)
        low, high = rows.agg(F.min(pruned_by), F.max(pruned_by)).first()
        there = there.filter(F.col(pruned_by).isNull() | F.col(pruned_by).between(F.lit(low), F.lit(high)))
    part = f"part=p{uuid.uuid4().hex}"
    fresh = insert_if_absent(there, rows, keys, order_by)
    (write or (lambda df, path: df.write.parquet(path)))(fresh, f"{folder}/data/{part}")
    spark.createDataFrame([(batch, part, rows.schema.json())], _COMMIT).coalesce(1).write.mode("append").parquet(f"{folder}/commits/batch-{uuid.uuid4().hex}")
    return True
