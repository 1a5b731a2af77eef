"""Token-id files of bit planes (operator 10).

File format (all numbers little-endian)::

    b"TWPLANE1"
    chunk *              each: the planes of one block of ids, one zstandard frame per plane
    chunk index          zstandard frame of unsigned 32-bit numbers: 1 + planes per chunk:
                         the ids in the chunk, then the bytes of each plane's frame
    document index       zstandard frame of signed 64-bit numbers: per document its doc_id,
                         1 if the doc_id is null, and its number of ids
    footer               7 unsigned 64-bit numbers: ids, documents, chunks, ids per block,
                         planes, bytes of the chunk index, bytes of the document index
    b"TWPLANE1"

A block of n ids is transposed into ``planes`` rows of ceil(n/8) bytes: row b holds bit b
of every id (bit planes), or, with ``unit="byte"``, rows of n bytes hold byte b.  High
planes are nearly constant and shrink to a few bytes.  A chunk can be found and decoded
alone: offsets are the running sum of the chunk index.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import as_uri, pick, put_file, written
from tidewatch.session import scratch_path

MAGIC = b"TWPLANE1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 22
ROWS_PER_TASK = 10_000
END_ID = 1
CACHED_PARTS = 400_000
SLICE_CHARS = 1 << 20


def to_planes(ids: np.ndarray, planes: int, unit: str) -> list[bytes]:
    """The planes of one block."""
    if unit == "byte":
        parts = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [parts[:, b].tobytes() for b in range(planes)]
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=planes, bitorder="little")
    return [row.tobytes() for row in np.packbits(bits.T, axis=1, bitorder="little")]


def from_planes(rows: list[bytes], n: int, unit: str) -> np.ndarray:
    parts = np.zeros((n, 4), np.uint8)
    if unit == "byte":
        for b, row in enumerate(rows):
            parts[:, b] = np.frombuffer(row, np.uint8)
    else:
        bits = np.unpackbits(np.stack([np.frombuffer(r, np.uint8) for r in rows]), axis=1, count=n, bitorder="little")
        packed = np.packbits(bits.T, axis=1, bitorder="little")
        parts[:, : packed.shape[1]] = packed
    return parts.reshape(-1).view("<u4")


def planes_for(largest: int, unit: str) -> int:
    bits = max(1, int(largest).bit_length())
    return bits if unit == "bit" else (bits + 7) // 8


class FileWriter:
    """Collects documents and writes one file; holds one block of ids besides the compressed chunks."""

    def __init__(self, largest_id: int, unit: str = "byte", block_ids: int = BLOCK_IDS):
        import zstandard

        self.zip = zstandard.ZstdCompressor(level=3)
        self.unit, self.block_ids, self.planes = unit, block_ids, planes_for(largest_id, unit)
        self.open: list[np.ndarray] = []
        self.open_ids = self.n_ids = 0
        self.chunks: list[bytes] = []
        self.index: list[int] = []
        self.docs: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs += [doc_id or 0, int(doc_id is None), len(ids)]
        self.open.append(ids)
        self.open_ids += len(ids)
        self.n_ids += len(ids)
        if self.open_ids >= self.block_ids:
            every = np.concatenate(self.open)
            whole = len(every) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._chunk(every[at : at + self.block_ids])
            self.open, self.open_ids = [every[whole:]], len(every) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        frames = [self.zip.compress(p) for p in to_planes(ids, self.planes, self.unit)]
        self.index += [len(ids), *map(len, frames)]
        self.chunks.append(b"".join(frames))

    def finish(self, stream) -> None:
        if self.open_ids:
            self._chunk(np.concatenate(self.open))
            self.open, self.open_ids = [], 0
        index = self.zip.compress(np.array(self.index, "<u4").tobytes())
        docs = self.zip.compress(np.array(self.docs, "<i8").tobytes())
        stream.write(MAGIC)
        for chunk in self.chunks:
            stream.write(chunk)
        footer = (self.n_ids, len(self.docs) // 3, len(self.chunks), self.block_ids, self.planes, len(index), len(docs))
        stream.write(index + docs + struct.pack("<7Q", *footer) + MAGIC)


class FileReader:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes | memoryview, unit: str = "byte"):
        import zstandard

        self.data, self.unit, self.unzip = memoryview(data), unit, zstandard.ZstdDecompressor()
        if bytes(self.data[:8]) != MAGIC or bytes(self.data[-8:]) != MAGIC:
            raise ValueError("not a whole token file")
        self.n_ids, n_docs, n_chunks, self.block_ids, self.planes, index_bytes, doc_bytes = struct.unpack("<7Q", self.data[-64:-8])
        doc_at = len(self.data) - 64 - doc_bytes
        index = self.unzip.decompress(self.data[doc_at - index_bytes : doc_at])
        self.index = np.frombuffer(index, "<u4").reshape(n_chunks, 1 + self.planes).astype(np.int64)
        self.docs = np.frombuffer(self.unzip.decompress(self.data[doc_at : doc_at + doc_bytes]), "<i8").reshape(n_docs, 3)
        self.chunk_at = 8 + np.concatenate([[0], np.cumsum(self.index[:, 1:].sum(axis=1))])

    def chunk(self, k: int) -> np.ndarray:
        at, rows = int(self.chunk_at[k]), []
        for size in self.index[k, 1:]:
            rows.append(self.unzip.decompress(self.data[at : at + int(size)]))
            at += int(size)
        return from_planes(rows, int(self.index[k, 0]), self.unit)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in file order; at most a document and one chunk are decoded at a time."""
        held, k = np.zeros(0, "<u4"), 0
        for doc_id, is_null, n in self.docs.tolist():
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.chunk(k))
                have += len(more[-1])
                k += 1
            held = np.concatenate(more) if len(more) > 1 else held
            yield (None if is_null else doc_id), held[:n]
            held = held[n:]


# The rules of the tokenizer file that make parts between blanks independent.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL_FORMS = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
WORD_END = "</w>"
# SPLIT over lowered ASCII and the Latin letters that NFC and lower-casing treat one by one
_LETTERS = r"\xc0-\xd6\xd8-\xf6\xf8-įı-ňŊ-ž"
_PLAIN = re.compile(rf"[\t\n\r -~{_LETTERS}]*")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+")


def _splits_alike(state: dict) -> bool:
    """Whether a tokenizer's normaliser, splitter and model are the ones named above."""
    normal = [(n.get("type"), (n.get("pattern") or {}).get("Regex")) for n in (state.get("normalizer") or {}).get("normalizers", [])]
    steps = (state.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = state.get("model") or {}
    return (
        normal == NORMAL_FORMS
        and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": SPLIT}, "Removed", True)
        and (steps[1].get("add_prefix_space"), steps[1].get("use_regex")) == (False, False)
        and (model.get("type"), model.get("dropout"), model.get("end_of_word_suffix")) == ("BPE", None, WORD_END)
    )


class WordEncoder:
    """Ids of whole texts by the tokenizer of a file, with what it has seen remembered.

    The tokenizer drops white space and never joins pieces over it, so a text's ids are those
    of its parts between blanks in turn; a text of plain characters falls into pieces (letter
    runs, single digits, runs of symbols), whose ids follow one another likewise.  Unseen
    pieces are encoded many to a call with blanks between them and cut apart where a token
    ends a word; the parts of other texts by the offsets of their tokens.  ``exact`` says
    whether the file's rules are those that this rests on and no added token has white space;
    otherwise whole texts are encoded.  Either memory is cleared at ``CACHED_PARTS``; texts are
    taken in slices of about ``SLICE_CHARS`` characters, cut at blanks.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kinds = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = sorted({t.content[:2] for t in kinds})  # a text without any has no added token
        state = json.loads(self.tokenizer.to_str())
        self.exact = _splits_alike(state) and not any(any(c.isspace() for c in t.content) or t.lstrip or t.rstrip for t in kinds)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.largest = max(vocabulary.values())
        self.ends_word = np.zeros(self.largest + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_pieces(self, new: list[str]) -> None:
        (found,) = self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()]
        if len(cuts) != len(new) + 1 or cuts[-1] != 4 * len(ids):  # a piece without an end of its own
            self.pieces.update((p, self._whole(p)) for p in new)
            return
        held = ids.tobytes()
        for k, piece in enumerate(new):
            self.pieces[piece] = held[cuts[k] : cuts[k + 1]]

    def _learn_by_offsets(self, new: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
        begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)])
        cuts, held = (4 * np.searchsorted(starts, begins)).tolist(), ids.tobytes()
        for k, part in enumerate(new):
            self.parts[part] = held[cuts[k] : cuts[k + 1]]

    def _joined(self, split: list[list[str]], memory: dict[str, bytes], learn) -> list[bytes]:
        """Ids of lists of pieces or parts, after learning the unseen ones."""
        every = set().union(*split)
        new = every.difference(memory)
        if len(memory) + len(new) > CACHED_PARTS:
            memory.clear()
            new = every
        if new:
            learn(list(new))
        known = memory.__getitem__
        return [b"".join(map(known, own)) for own in split]

    def _known(self, slices: list[str]) -> list[bytes]:
        """Ids of a few slices, as bytes."""
        plain = [bool(_PLAIN.fullmatch(t)) and not any(m in t for m in self.marks) for t in slices]
        pieces = [_PIECE.findall(t.lower()) for t, is_plain in zip(slices, plain) if is_plain]
        parts = [t.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") for t, is_plain in zip(slices, plain) if not is_plain]
        by_piece = iter(self._joined(pieces, self.pieces, self._learn_pieces))
        by_part = iter(self._joined(parts, self.parts, self._learn_by_offsets))
        return [next(by_piece if is_plain else by_part) for is_plain in plain]

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit numbers; null has none."""
        held: list[str] = []
        last: list[bool] = []  # whether a held slice ends its text
        size, begun = 0, []

        def ready() -> Iterator[bytes]:
            for ids, ends in zip(self._known(held), last):
                begun.append(ids)
                if ends:
                    yield b"".join(begun) if len(begun) > 1 else ids
                    begun.clear()
            held.clear()
            last.clear()

        for text in texts:
            text = text or ""
            if not self.exact:
                yield self._whole(text) if text else b""
                continue
            at = 0
            while True:
                end = text.find(" ", at + SLICE_CHARS) if at + SLICE_CHARS < len(text) else -1
                held.append(text[at:end] if end >= 0 else text[at:])
                last.append(end < 0)
                size += len(held[-1])
                if size >= SLICE_CHARS:
                    yield from ready()
                    size = 0
                if end < 0:
                    break
                at = end
        yield from ready()

    def encode(self, text: str | None) -> np.ndarray:
        (ids,) = self.encode_many([text])
        return np.frombuffer(ids, "<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One per Python worker, so that what it has learnt serves the next task too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, unit: str = "byte", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS
) -> tuple[str, DataFrame]:
    """Encode every text, append ``end_id``, write files in ascending doc_id order.

    Returns the folder and its manifest: ``file, first_part, part_no, n_docs, n_ids``.
    Null ids sort first, rows of one id by a hash of the text (rows that repeat both are equal);
    null and empty texts have the end id only; texts of any length are encoded in slices and may
    make a file longer; an empty table makes no file and an empty manifest; other columns are
    ignored.  Documents are dealt by ranges of doc_id once; a task writes files of about
    ``file_ids`` ids, so its memory does not grow with its share.
    """
    spark = docs.sparkSession
    folder = as_uri(folder or scratch_path(spark, "token-files"))
    rows = pick(docs, doc_id="long", text="string")
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.select("doc_id").count() // ROWS_PER_TASK))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        largest = max(encoder.largest, end_id)
        made: list[tuple] = []
        out = FileWriter(largest, unit, block_ids)

        def close() -> None:
            name = f"part-{part:08d}-{len(made):06d}.twp"
            put_file(folder, name, out.finish)
            made.append((name, part, len(made), len(out.docs) // 3, out.n_ids))

        end = struct.pack("<I", end_id)
        for batch in batches:
            texts = (v.as_py() for v in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(texts)):
                out.add(doc_id, np.frombuffer(ids + end, "<u4"))
                if out.n_ids >= file_ids:
                    close()
                    out = FileWriter(largest, unit, block_ids)
        if out.docs:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names=["file", "part", "part_no", "n_docs", "n_ids"])

    manifest = written(ordered.mapInArrow(write, "file string, part long, part_no long, n_docs long, n_ids long"), "token-manifest")
    return folder, manifest


def read_token_files(folder: str, manifest: DataFrame, unit: str = "byte", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``doc_id, start, n_tokens, ids_crc32`` (and ``ids``).

    ``start`` counts the ids of all documents before it.  The running sum goes over the
    manifest alone: one narrow row per file.  Each file is then read by one task.
    """
    from pyarrow import fs

    before = W.orderBy("part", "part_no").rowsBetween(W.unboundedPreceding, -1)
    starts = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    kept = [c for c in ("doc_id", "start", "n_tokens", "ids_crc32", "ids") if with_ids or c != "ids"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base_path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base_path}/{name}") as stream:
                    reader, rows = FileReader(stream.read(), unit), []
                for doc_id, ids in reader.documents():
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None))
                    at += len(ids)
                    if len(rows) == 4096:
                        yield _batch(rows, kept)
                        rows = []
                if rows:
                    yield _batch(rows, kept)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return starts.repartition(max(1, manifest.count())).mapInArrow(decode, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(columns, kinds))[: len(names)]], names=names)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files and read them back."""
    return read_token_files(*write_token_files(docs, tokenizer_path, end_id=end_id))
