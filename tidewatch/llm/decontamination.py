"""Benchmark decontamination with an index per training shard (operator 6).

A task reads its documents in shards of bounded size, indexes each (``fm_index``), searches
the windows of all benchmark items backwards through it, locates the occurrences and merges
them to spans.  The items' word hashes lie in files of bounded size in the shared folder,
made by a Spark job: every shard reads them one after another, so the number of items bounds
neither the driver nor a task, and the corpus is read once and never shuffled.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewatch.llm.common import as_uri, pick, put_file, text_bytes
from tidewatch.llm.fm_index import FMIndex, hash_words
from tidewatch.session import scratch_path

WINDOW_WORDS = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 500_000

_RESULT = "doc_id long, text_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first_word:long,n_words:long,first_char:long,end_char:long>>"
_SPAN = pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("first_char", pa.int64()), ("end_char", pa.int64())])


def write_item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> str:
    """Word hashes of all items as files of about ``block_words`` words; returns their folder.

    Items without words have no window and are left out.  An item's id is kept as text;
    a null id is kept as null: its windows hit, it is not counted among the items.
    """
    folder = as_uri(scratch_path(items.sparkSession, "item-blocks"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, hashes = TaskContext.get().partitionId(), 0, [], []

        def close() -> None:
            def save(stream) -> None:
                held = io.BytesIO()
                lengths = np.array([len(h) for h in hashes], np.int64)
                named = np.array([i is not None for i in ids], bool)
                np.savez(held, words=np.concatenate(hashes), lengths=lengths, named=named, ids=np.array([i or "" for i in ids], dtype=np.str_))
                stream.write(held.getvalue())

            put_file(folder, f"block-{part:06d}-{made:06d}.npz", save)

        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            found, starts, _ = hash_words(data, ends)
            bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
            for k, item_id in enumerate(batch.column(0).to_pylist()):
                own = found[bounds[k] : bounds[k + 1]]
                if len(own):
                    ids.append(item_id)
                    hashes.append(own)
                if sum(map(len, hashes[-1:])) and sum(map(len, hashes)) >= block_words:
                    close()
                    made, ids, hashes = made + 1, [], []
        if hashes:
            close()
            made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made])], names=["n"])

    pick(items, item_id="string", text="string").mapInArrow(write, "n long").agg({"n": "sum"}).collect()
    return folder


def _blocks(folder: str) -> Iterator[dict[str, np.ndarray]]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    for path in sorted(f.path for f in found if f.base_name.startswith("block-")):
        with store.open_input_file(path) as stream:
            yield dict(np.load(io.BytesIO(stream.read()), allow_pickle=False))


def _windows(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and item of every window."""
    per = np.maximum(lengths - size + 1, 1)
    item = np.repeat(np.arange(len(lengths)), per)
    base = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), per)
    within = np.arange(per.sum()) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    return base + within, np.minimum(lengths[item], size), item


def search_shard(index: FMIndex, blocks: Iterator[dict[str, np.ndarray]], size: int = WINDOW_WORDS) -> tuple[np.ndarray, list[set[str]]]:
    """Which places of the shard's sequence are hit, and the items found per document."""
    change = np.zeros(index.n + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(index.doc_starts) - 1)]
    for block in blocks:
        symbols = index.number(block["words"])
        first, length, item = _windows(block["lengths"], size)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            phrases = symbols[first[own][:, None] + np.arange(n)]
            present = (phrases >= 0).all(axis=1)
            own, phrases = own[present], phrases[present]
            if not len(own):
                continue
            phrases, which = np.unique(phrases, axis=0, return_inverse=True)
            low, high = index.find(phrases)
            times = high - low
            rows = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            if not len(rows):
                continue
            places, phrase = index.locate(rows), np.repeat(np.arange(len(phrases)), times)
            np.add.at(change, places, 1)
            np.add.at(change, places + n, -1)
            doc = np.searchsorted(index.doc_starts, places, side="right") - 1
            holders = [[] for _ in range(len(phrases))]
            for p, i in zip(which.reshape(-1), item[own]):
                if block["named"][i]:
                    holders[p].append(str(block["ids"][i]))
            for d, p in np.unique(np.stack([doc, phrase], axis=1), axis=0):
                items[d].update(holders[p])
    return np.cumsum(change[:-1]) > 0, items


def _shard_rows(ids: list, hashes: list, data: np.ndarray, ends: np.ndarray, folder: str, size: int) -> pa.RecordBatch:
    found, starts, stops = hash_words(data, ends)
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    lengths = np.diff(bounds)
    index = FMIndex(found, lengths)
    hit, items = search_shard(index, _blocks(folder), size)
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[index.doc_starts[1:]] - sums[index.doc_starts[:-1]]
    spans: list[list] = [[] for _ in ids]
    if hit.any():
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            d = int(np.searchsorted(index.doc_starts, a, side="right")) - 1
            w, n = int(a - index.doc_starts[d]), int(b - a)
            text_at = chars[ends[d - 1]] if d else 0
            first, last = bounds[d] + w, bounds[d] + w + n - 1
            spans[d].append({"first_word": w, "n_words": n, "first_char": int(chars[starts[first]] - text_at), "end_char": int(chars[stops[last]] - text_at)})
    listed = [sorted(s) for s in items]
    columns = [
        pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(lengths, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(s) for s in listed], pa.int64()),
        pa.array([hashlib.sha256(",".join(s).encode()).hexdigest() for s in listed]), pa.array(n_hit > 0), pa.array(listed, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])


def contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: how much of it occurs in the items, which items, and where.

    ``doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, items, spans``;
    spans are merged runs of hit words with their characters, for ``without_spans``.  A null
    text or item has no words; a null doc_id stays null; repeated rows are each answered;
    an empty table of documents gives no rows, one of items gives no hits; a document larger
    than ``shard_bytes`` is a shard by itself; other columns are ignored.
    """
    from pyspark.sql import functions as F

    folder = write_item_blocks(items)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, held, ends, size = [], [], [], [], 0
        for batch in batches:
            data, stops = text_bytes(batch.column(2))
            at = first = 0
            own_ids, own_hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, stop in enumerate(stops.tolist()):
                ids.append(own_ids[k])
                hashes.append(own_hashes[k])
                ends.append(size + stop - first)
                if ends[-1] >= shard_bytes:
                    yield _shard_rows(ids, hashes, np.concatenate([*held, data[first:stop]]), np.array(ends, np.int64), folder, window_words)
                    ids, hashes, held, ends, size, first = [], [], [], [], 0, stop
                at = stop
            held.append(data[first:at].copy())
            size += at - first
        if ids:
            yield _shard_rows(ids, hashes, np.concatenate([*held, np.zeros(0, np.uint8)]), np.array(ends, np.int64), folder, window_words)

    rows = pick(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(scan, _RESULT)


def without_spans(text: str | None, spans: list) -> str | None:
    """The text with the characters of its spans taken out."""
    if text is None or not spans:
        return text
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : span["first_char"]])
        at = span["end_char"]
    return "".join([*kept, text[at:]])
