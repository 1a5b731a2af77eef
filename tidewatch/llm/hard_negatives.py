"""Hard negatives for every positive of every anchor (operator 13), by Kronecker-packed products.

Components are whole numbers.  Raised by a bias they are at least 0, and the components of
several candidates fit side by side into one wide integer, each in a field wide enough for
the largest inner product: ``packed[j] = c1[j] + c2[j] * 2**w + c3[j] * 4**w``.  Multiplying
it by an anchor's component (raised too) and adding up over j gives all the candidates' inner
products at once, none running into the next field.  The fields are cut apart and the biases
taken off: the scores are exact.  While the whole integer stays below 2**53 a double holds it
exactly, and the multiplications are one matrix product; else Python's integers of any size
are used, with more fields.

Anchors lie in files of ``block_rows`` rows in the shared folder, made by Spark jobs.  Every
task reads its candidates in batches of bounded size and passes over the files once per batch,
keeping the best few per anchor, so that neither the candidates nor the anchors pass through
the driver or have to fit into a task.  The best of all batches are found by a window.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import as_uri, pick, put_file, written
from tidewatch.session import scratch_path

ANCHOR_STEP = 100
POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
SCALE = 256
BLOCK_ROWS = 1024
BATCH_ROWS = 32_768
EXACT_BITS = 53  # whole numbers below 2**53 are exact in a double
WIDE_FIELDS = 8
LONG_MOST = (1 << 63) - 1


def pack(candidates: np.ndarray, fields: int, width: int) -> np.ndarray:
    """Rows of components >= 0 to ``ceil(n / fields)`` rows of packed integers."""
    n, d = candidates.shape
    groups = -(-n // fields)
    held = np.zeros((groups * fields, d), candidates.dtype)
    held[:n] = candidates
    held = held.reshape(groups, fields, d)
    step = candidates.dtype.type(1 << width) if candidates.dtype != object else 1 << width
    return reduce(lambda high, f: high * step + held[:, f], reversed(range(fields)), np.zeros((groups, d), candidates.dtype))


def unpack(products: np.ndarray, n: int, fields: int, width: int) -> np.ndarray:
    """Fields of the products: one column per candidate."""
    whole = products if products.dtype == object else products.astype(np.int64)
    mask = (1 << width) - 1
    cut = np.stack([(whole >> (f * width)) & mask for f in range(fields)], axis=-1)
    return cut.reshape(len(products), -1)[:, :n]


def scores(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; beyond a long, the nearest long."""
    if not len(anchors) or not len(candidates) or not anchors.shape[1]:
        return np.zeros((len(anchors), len(candidates)), np.int64)
    raised_a, raised_c = max(0.0, -float(anchors.min())), max(0.0, -float(candidates.min()))
    most = float((anchors.max() + raised_a) * (candidates.max() + raised_c)) * anchors.shape[1]
    if most < 1 << 40:  # a closer bound: the largest lengths of raised vectors
        a, c = anchors + raised_a, candidates + raised_c
        most = min(most, math.sqrt(float((a * a).sum(axis=1).max()) * float((c * c).sum(axis=1).max())) + 1)
        width = max(1, int(most).bit_length())
        fields = EXACT_BITS // width
        if fields > 1:
            raw = unpack(a @ pack(c, fields, width).T, len(c), fields, width)
            off = raised_c * a.sum(axis=1)[:, None] + raised_a * candidates.sum(axis=1)[None, :]
            return raw - off.astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    a, c = whole(anchors), whole(candidates)
    up_a, up_c = int(raised_a), int(raised_c)
    a, c = a + up_a, c + up_c
    width = max(1, (int(a.max()) * int(c.max()) * a.shape[1]).bit_length())
    raw = unpack(a @ pack(c, WIDE_FIELDS, width).T, len(c), WIDE_FIELDS, width)
    exact = raw - up_c * a.sum(axis=1)[:, None] - up_a * (c - up_c).sum(axis=1)[None, :]
    return np.clip(exact, -LONG_MOST, LONG_MOST).astype(np.int64)


def _ranks(row: np.ndarray) -> np.ndarray:
    """Places by falling score; equal scores keep their order."""
    return np.argsort(-row, kind="stable")


def _matrix(column, width: int = 0) -> np.ndarray:
    """Rows of a list column as doubles; shorter ones are filled with 0."""
    lists = column.to_numpy(zero_copy_only=False)
    width = max([width, *map(len, lists)])
    out = np.zeros((len(lists), width))
    for k, own in enumerate(lists):
        out[k, : len(own)] = own
    return out


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (a, b))


def valid_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, components as whole numbers in doubles.

    Left out: a null label, a null vector, any null or non-finite component (also one that is
    no longer finite when multiplied by ``SCALE``).
    """
    rows = pick(vectors, vec_id="long", embedding="array<double>", label="long").where("label IS NOT NULL AND embedding IS NOT NULL")
    whole = rows.select("vec_id", "label", F.transform("embedding", lambda x: x * float(SCALE)).alias("v"))
    fine = whole.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = pa.array(np.floor(lists.flatten().to_numpy(zero_copy_only=False)))
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["vec_id", "label", "vector"])

    return written(fine.select("vec_id", relabelled.alias("label"), "v").mapInArrow(floors, "vec_id long, label long, vector array<double>"), "vectors")


def _write_anchors(anchors: DataFrame, block_rows: int) -> tuple[str, DataFrame]:
    """Anchors in files of at most ``block_rows``; the folder, and ``anchor, anchor_id, label, vector`` per row.

    ``anchor`` numbers the rows: file and place in it.
    """
    folder = as_uri(scratch_path(anchors.sparkSession, "anchor-blocks"))
    schema = "anchor long, anchor_id long, label long, vector array<double>"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                block = batch.slice(at, block_rows)
                numbers = ((part << 24) + made) * block_rows + np.arange(block.num_rows)

                def save(stream) -> None:
                    held = io.BytesIO()
                    own_ids = block.column(0).to_numpy(zero_copy_only=False)  # anchors have ids
                    np.savez(held, anchor=numbers, anchor_id=own_ids, label=block.column(1).to_numpy(), vector=_matrix(block.column(2)))
                    stream.write(held.getvalue())

                put_file(folder, f"block-{part:06d}-{made:06d}.npz", save)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *block.columns], names=["anchor", "anchor_id", "label", "vector"])
                made += 1

    return folder, written(anchors.select("vec_id", "label", "vector").mapInArrow(write, schema), "anchors")


def _blocks(folder: str) -> Iterator[dict[str, np.ndarray]]:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
    for path in sorted(f.path for f in found if f.base_name.startswith("block-")):
        with store.open_input_file(path) as stream:
            yield dict(np.load(io.BytesIO(stream.read()), allow_pickle=False))


def _candidates(batches: Iterator[pa.RecordBatch], batch_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, whether they are null, labels and vectors of at most ``batch_rows`` rows, in order of id, null last."""

    def ready(held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = _matrix(rows.column(2).combine_chunks())
        void = rows.column(0).is_null().to_numpy()
        ids = rows.column(0).fill_null(0).to_numpy()
        order = np.lexsort((ids, void))
        return ids[order], void[order], rows.column(1).to_numpy()[order], vectors[order]

    held, size = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, batch_rows - size)
            held.append(part)
            at, size = at + part.num_rows, size + part.num_rows
            if size == batch_rows:
                yield ready(held)
                held, size = [], 0
    if held:
        yield ready(held)


def _best_positives(rows: DataFrame, folder: str, positives: int, batch_rows: int) -> DataFrame:
    """``anchor, p, positive_id, positive_score``: the best rows of the anchor's own label."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, void, labels, vectors in _candidates(batches, batch_rows):
            places = {int(v): np.flatnonzero(labels == v) for v in np.unique(labels)}
            for block in _blocks(folder):
                out: list[tuple] = []
                for label in np.unique(block["label"]).tolist():
                    own, near = np.flatnonzero(block["label"] == label), places.get(label)
                    if near is None:
                        continue
                    found = scores(*_even(block["vector"][own], vectors[near]))
                    same = (ids[near][None, :] == block["anchor_id"][own][:, None]) & ~void[near][None, :]
                    for k, a in enumerate(own):
                        others = np.flatnonzero(~same[k])
                        row = found[k][others]
                        if len(row) > 64:  # only those that reach the last place
                            reach = np.partition(row, len(row) - positives)[len(row) - positives]
                            others, row = others[row >= reach], row[row >= reach]
                        for i in _ranks(row)[:positives]:
                            at = near[others[i]]
                            out.append((int(block["anchor"][a]), None if void[at] else int(ids[at]), row[i]))
                if out:
                    anchor, vec, score = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["anchor", "positive_id", "positive_score"])

    found = rows.mapInArrow(scan, "anchor long, positive_id long, positive_score long")
    best = W.partitionBy("anchor").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last())
    return found.withColumn("p", F.row_number().over(best)).where(F.col("p") <= positives)


def _best_negatives(rows: DataFrame, folder: str, negatives: int, low: int, high: int, batch_rows: int) -> DataFrame:
    """``anchor, p, negative_id, negative_score``: the best rows of other labels inside each positive's band.

    The files hold, per anchor, its positives' scores.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, void, labels, vectors in _candidates(batches, batch_rows):
            for block in _blocks(folder):
                found = scores(*_even(block["vector"], vectors))
                out: list[tuple] = []
                for a in range(len(found)):
                    others = np.flatnonzero(labels != block["label"][a])
                    row = found[a][others]
                    wanted = [(p, s) for p, s in enumerate(block["scores"][a].tolist(), 1) if block["has"][a, p - 1] and s >= 0]
                    if not wanted or not len(row):
                        continue
                    tops = [s * high // 100 for _, s in wanted]
                    floors = [-(-s * low // 100) for _, s in wanted]
                    some = np.flatnonzero((row >= min(floors)) & (row <= max(tops)))
                    others, row = others[some], row[some]
                    order = _ranks(row)
                    others, row = others[order], row[order]
                    # searching falling scores: the first one at or below the top of the band
                    for (p, _), top, floor in zip(wanted, tops, floors):
                        first = int(np.searchsorted(-row, -top, side="left"))
                        for i in range(first, min(first + negatives, len(row))):
                            if row[i] < floor:
                                break
                            at = others[i]
                            out.append((int(block["anchor"][a]), p, None if void[at] else int(ids[at]), row[i]))
                if out:
                    anchor, p, vec, score = zip(*out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor, pa.int64()), pa.array(p, pa.int32()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], names=["anchor", "p", "negative_id", "negative_score"]
                    )

    found = rows.mapInArrow(scan, "anchor long, p int, negative_id long, negative_score long")
    best = W.partitionBy("anchor", "p").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)


def _with_scores(anchors: DataFrame, chosen: DataFrame, positives: int, block_rows: int) -> str:
    """The anchors that have a positive, in files again, now with their positives' scores."""
    listed = chosen.groupBy("anchor").agg(F.collect_list(F.struct("p", "positive_score")).alias("own"))  # at most ``positives``
    joined = anchors.join(listed, "anchor").select("anchor", "label", "vector", "own")
    folder = as_uri(scratch_path(anchors.sparkSession, "scored-blocks"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                block = batch.slice(at, block_rows)
                marks, has = np.zeros((block.num_rows, positives), np.int64), np.zeros((block.num_rows, positives), bool)
                for k, own in enumerate(block.column(3).to_pylist()):
                    for one in own:
                        marks[k, one["p"] - 1], has[k, one["p"] - 1] = one["positive_score"], True

                def save(stream) -> None:
                    held = io.BytesIO()
                    np.savez(held, anchor=block.column(0).to_numpy(), label=block.column(1).to_numpy(), vector=_matrix(block.column(2)), scores=marks, has=has)
                    stream.write(held.getvalue())

                put_file(folder, f"block-{part:06d}-{made:06d}.npz", save)
                made += 1
        yield pa.RecordBatch.from_arrays([pa.array([made])], names=["n"])

    joined.mapInArrow(write, "n long").agg({"n": "sum"}).collect()
    return folder


def hard_negatives(
    vectors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    anchor_step: int = ANCHOR_STEP,
    block_rows: int = BLOCK_ROWS,
    batch_rows: int = BATCH_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the valid rows (see ``valid_rows``) with an id divisible by ``anchor_step``.
    Ties of score go to the smaller id; a null id is no anchor and comes last among ties.
    Rows that repeat an id are rows of their own, each an anchor or a candidate, but a row
    with the anchor's id is never its positive.  Vectors of unequal length are compared as
    if filled up with 0; empty vectors score 0.  A positive of a negative score has no band.
    Scores beyond a long are taken as the nearest long.  An empty table gives no rows; other
    columns are ignored.
    """
    rows = valid_rows(vectors)
    folder, anchors = _write_anchors(rows.where(F.col("vec_id") % anchor_step == 0), block_rows)
    chosen = written(_best_positives(rows, folder, positives, batch_rows), "positives")
    found = _best_negatives(rows, _with_scores(anchors, chosen, positives, block_rows), negatives, low_percent, high_percent, batch_rows)
    named = found.join(chosen, ["anchor", "p"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
