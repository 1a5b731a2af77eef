"""Lines of text files with their byte offsets, read in ranges of fixed size."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
_CHUNK = 4 << 20


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else "file://" + quote(os.path.abspath(path))


def whole_lines(stream, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of consecutive whole lines that begin in [start, stop)."""
    position, kept = start, b""
    if start:  # the line around the start belongs to the range before
        position = start - 1
        stream.seek(position)
        while (cut := (piece := stream.read(_CHUNK)).find(b"\n")) < 0:
            if not piece:
                return
            position += len(piece)
        position, kept = position + cut + 1, piece[cut + 1 :]
    while position < stop:
        cut = kept.rfind(b"\n")
        if position + cut + 1 > stop:
            cut = kept.find(b"\n", stop - position - 1)
        if cut < 0:
            piece = stream.read(_CHUNK)
            if not piece:
                if kept:
                    yield position, kept
                return
            kept += piece
            continue
        yield position, kept[: cut + 1]
        position, kept = position + cut + 1, kept[cut + 1 :]


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class _RangeReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.size = options["path"], int(options["rangeBytes"])

    def partitions(self):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(base)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        hidden = lambda path: any(part[:1] in "_." for part in path[len(base) :].strip("/").split("/"))
        ranges = []
        for info in sorted((f for f in files if f.is_file and f.size and (f is found or not hidden(f.path))), key=lambda f: f.path):
            # Compressed files can't be entered in the middle.
            step = 1 << 62 if info.path.endswith(".gz") else self.size
            ranges += [_Range(info.path, at, at + step) for at in range(0, info.size, step)]
        return ranges or [_Range("", 0, 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        packed = partition.path.endswith(".gz")
        opened = store.open_input_stream(partition.path, compression="gzip") if packed else store.open_input_file(partition.path)
        with opened as stream:
            for offset, block in whole_lines(stream, partition.start, partition.stop):
                text = block.decode("utf-8", "replace").split("\n")
                starts = offset + np.concatenate([[0], np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1])
                count = len(text) - block.endswith(b"\n")
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(partition.path, count).cast(pa.string()), pa.array(starts[:count], pa.int64()), pa.array(text[:count], pa.string())],
                    names=["path", "offset", "value"],
                )


class LineRanges(DataSource):
    """``format("line_ranges")``: every line below a folder as (path, offset, value).

    Ranges depend on file sizes and ``rangeBytes`` alone, so a second read of a lost task, or
    another read of the folder, gives equal rows.  Lines end with ``\\n``; bytes that are
    not UTF-8 are replaced; names that start with ``_`` or ``.`` are left out.
    """

    @classmethod
    def name(cls):
        return "line_ranges"

    def schema(self):
        return "path string, offset bigint, value string"

    def reader(self, schema):
        return _RangeReader(self.options)


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(LineRanges)
    return spark.read.format("line_ranges").options(rangeBytes=range_bytes).load(as_uri(path))
