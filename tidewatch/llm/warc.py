"""WARC archives: writer, normaliser of monolithic gzip files, indexed reader (operator 4).

``write_monolithic`` lets Spark's own text writer make files that are one gzip stream each,
the form in which many tools leave an archive and in which no record can be read alone.
``normalise`` inflates each such stream once, piece by piece, rewrites every record as its
own gzip member and puts a sidecar index of offsets beside the archive.  ``read_indexed``
fetches members by offset, so that a large archive is read by many tasks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import as_uri, pick, put_file, written
from tidewatch.session import scratch_path

SMALLEST_SHARED = 100
RECORDS_PER_FILE = 4_000
MEMBERS_PER_TASK = 4_000
PIECE_BYTES = 1 << 18
WRITTEN_AT = "2024-01-31T00:00:00Z"
CRLF = "\r\n"

_INDEX = "archive string, record long, offset long, length long, record_type string, page_id long"


def classify(pages: DataFrame, smallest: int = SMALLEST_SHARED) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``.

    Of equal payloads of at least ``smallest`` bytes the smallest page_id is the response
    and the others revisit it.  Null html is an empty payload.  Rows that repeat the smallest
    page_id are all responses.  A null page_id never is a response for others: a group of
    null ids only has no page to refer to and stays as responses.

    Digests are counted before the shuffle and joined back without payloads of their own
    being moved by digest: only digests shared by several rows take part in the join.
    """
    rows = pick(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("payload")
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    shared = (
        rows.where(F.col("payload_bytes") >= smallest)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first_page").isNotNull())
        .select(F.col("payload_digest").alias("shared_digest"), "first_page")
    )
    joined = rows.join(shared, (F.col("payload_digest") == F.col("shared_digest")) & (F.col("payload_bytes") >= smallest), "left")
    again = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first_page")).alias("refers_to"),
    )


def _header(*lines: Column | str) -> Column:
    """Header lines, null ones left out, and the empty line."""
    return F.concat(F.concat_ws(CRLF, *[F.lit(x) if isinstance(x, str) else x for x in lines]), F.lit(CRLF + CRLF))


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value)


def _record_id(page: Column) -> Column:
    """A stable URN of a page's record."""
    h = F.md5(page.cast("string").cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(classified: DataFrame, written_at: str = WRITTEN_AT) -> DataFrame:
    """One text column ``value``: a whole WARC record without its closing two line ends."""
    is_response = F.col("record_type") == "response"
    http = _header("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _field("Content-Length", F.col("payload_bytes").cast("string")))
    block = F.when(is_response, F.concat(http, "payload")).otherwise(http)
    clean_url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    value = F.concat(
        _header(
            "WARC/1.1",
            _field("WARC-Type", F.col("record_type")),
            _field("WARC-Record-ID", F.coalesce(_record_id(F.col("page_id")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
            f"WARC-Date: {written_at}",
            _field("WARC-Target-URI", clean_url),
            _field("X-Page-Id", F.col("page_id").cast("string")),
            _field("X-Payload-Length", F.col("payload_bytes").cast("string")),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
            F.when(~is_response, _field("WARC-Refers-To", _record_id(F.col("refers_to")))),
            F.when(~is_response, _field("X-Refers-To-Page-Id", F.col("refers_to").cast("string"))),
            F.when(~is_response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            "Content-Type: application/http; msgtype=response",
            _field("Content-Length", F.octet_length(block).cast("string")),
        ),
        block,
    )
    return classified.select(value.alias("value"))


def write_monolithic(record_rows: DataFrame, folder: str, per_file: int = RECORDS_PER_FILE) -> None:
    """Files of one gzip stream each; the writer's line end closes a record."""
    record_rows.write.option("compression", "gzip").option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", per_file).text(folder)


class _Stream:
    """The inflated bytes of a gzip file, whatever its members, asked for in parts."""

    def __init__(self, source):
        self.source, self.inflate, self.held, self.rest = source, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        data = self.rest or self.source.read(PIECE_BYTES)
        if not data:
            return False
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        self.held += self.inflate.decompress(data, PIECE_BYTES)
        self.rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the stream."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends inside a record")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            if piece:
                yield piece


def parse_header(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split(CRLF)
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:]) if name.strip()}


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def rewrite(source, target) -> Iterator[tuple[int, int, int, str, int | None]]:
    """Copy an archive record by record, each its own gzip member.

    Yields record number, offset, length, type and page id.  Holds one piece of a record.
    """
    stream, offset, number = _Stream(source), 0, 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = parse_header(head)
        packer, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        for piece in (head, *([] if "content-length" not in fields else stream.take(int(fields["content-length"])))):
            length += target.write(packed) if (packed := packer.compress(piece)) else 0
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer or shorter than it says")
        packed = packer.compress(b"\r\n\r\n") + packer.flush()
        length += target.write(packed)
        yield number, offset, length, fields.get("warc-type", ""), _number(fields.get("x-page-id"))
        offset, number = offset + length, number + 1


def normalise(folder: str, out_folder: str) -> DataFrame:
    """Rewrite all monolithic files of a folder; returns the index of all members.

    Each archive gets a sidecar ``<archive>.idx`` of tab-separated lines: record, offset,
    length, type, page id.  The same rows come back as a table in the shared folder.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    out_folder = as_uri(out_folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    # only names travel: a task opens its archives itself and inflates them in pieces
    n_files = max(1, files.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                name, rows = inner.rsplit("/", 1)[1].split(".")[0] + ".warc.gz", []

                def copy(target, store=store, inner=inner, rows=rows) -> None:
                    with store.open_input_stream(inner, compression=None) as source:
                        rows.extend(rewrite(source, target))

                put_file(out_folder, name, copy)
                lines = "".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in rows)
                put_file(out_folder, name + ".idx", lambda target, lines=lines: target.write(lines.encode()))
                if rows:
                    numbers, offsets, lengths, kinds, pages = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows)), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(kinds), pa.array(pages, pa.int64())],
                        names=["archive", "record", "offset", "length", "record_type", "page_id"],
                    )

    return written(files.repartition(n_files).mapInArrow(work, _INDEX), "warc-index")


def read_indexed(folder: str, index: DataFrame, with_payload: bool = False, per_task: int = MEMBERS_PER_TASK) -> DataFrame:
    """Read members by offset and answer for each from the archive itself.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for,
    ``url, payload``.  Length and digest of a response are taken from its bytes and must
    agree with its header; a revisit has both in its header.
    """
    folder = as_uri(folder)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if with_payload else "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        opened, stream = None, None
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != opened:
                    if stream is not None:
                        stream.close()
                    opened, stream = archive, store.open_input_file(f"{base}/{archive}")
                stream.seek(offset)
                record = zlib.decompress(stream.read(length), 31)
                at = record.index(b"\r\n\r\n") + 4
                fields = parse_header(record[:at])
                block = memoryview(record)[at : at + int(fields["content-length"])]
                body = block[bytes(block[:4096]).index(b"\r\n\r\n") + 4 :]
                n, digest, kind = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                if kind == "response" and (len(body), hashlib.sha256(body).hexdigest()) != (n, digest):
                    raise ValueError(f"record at {offset} of {archive} is damaged")
                row = (_number(fields.get("x-page-id")), n, digest, kind, _number(fields.get("x-refers-to-page-id")))
                if with_payload:
                    row += (fields.get("warc-target-uri"), bytes(body) if kind == "response" else None)
                    size += len(body)
                rows.append(row)
                if len(rows) == 2048 or size > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if stream is not None:
            stream.close()

    parts = max(1, -(-index.count() // per_task))
    spread = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(read, schema)


def archive_pages(pages: DataFrame, smallest: int = SMALLEST_SHARED) -> DataFrame:
    """Write a record per page, normalise the archives, read them back by their index.

    Repeated rows get a record each; an empty table gives empty archives and no rows; other
    columns are ignored.
    """
    spark = pages.sparkSession
    raw, out = scratch_path(spark, "warc-monolithic"), scratch_path(spark, "warc")
    write_monolithic(records(classify(pages, smallest)), raw)
    return read_indexed(out, normalise(raw, out))
