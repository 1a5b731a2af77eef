"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import prepare, scratch_path

# A word of the text rules: anything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, found by exact name and cast to the given types.

    Other columns, also those whose names differ in case only, are left behind.
    """
    names = list(df.columns)
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select([plain[f"_{names.index(n)}"].cast(t).alias(n) for n, t in types.items()])


def beside(df: DataFrame, **wanted: str) -> tuple[DataFrame, list[str]]:
    """All columns under positional names ``_0``..., followed by copies of the wanted ones.

    Returns the frame and the original names, for ``original`` to put back.
    """
    names = list(df.columns)
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select("*", *[plain[f"_{names.index(n)}"].cast(t).alias(n) for n, t in wanted.items()]), names


def original(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select([f"_{i}" for i in range(len(names))]).toDF(*names)


def words(text: Column) -> Column:
    """Array of the words of a text; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """The fifth of all ids that no model learns from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values laid end to end, and where each value ends; null is empty."""
    import pyarrow as pa

    filled = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return whole, offsets[1:] - offsets[0]


def text_slices(column, most_bytes: int):
    """(first row, end row, bytes, ends) of consecutive rows of at most so many bytes, one row at least."""
    data, ends = text_bytes(column)
    row, at = 0, 0
    while row < len(ends):
        stop = max(row + 1, int(np.searchsorted(ends, at + most_bytes, side="right")))
        yield row, stop, data[at : ends[stop - 1]], ends[row:stop] - at
        row, at = stop, int(ends[stop - 1])


def put_file(folder: str, name: str, write) -> None:
    """Make one file of the shared folder from a task.

    ``write(stream)`` fills a file of this attempt alone, which then takes the final
    name, so a second attempt after a lost executor replaces a whole file by an equal one.
    A file that a lost attempt left there goes first: some stores refuse to rename onto it.
    """
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    own = f"{base}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own, compression=None) as stream:
        write(stream)
    final = f"{base}/{name}"
    if store.get_file_info(final).type != fs.FileType.NotFound:
        store.delete_file(final)
    store.move(own, final)


def as_uri(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder)
