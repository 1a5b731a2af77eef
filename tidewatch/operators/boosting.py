"""Boosted trees for two classes: rows lie as bin codes in cached blocks, a level of a tree is one short job.

The trees are those of Spark's ``GBTClassifier`` (logistic loss, variance gain, means as leaves; the
first tree is fitted to the labels, with weight 1).  What differs is how a level is counted: no row
is an object, features of few values share a column of codes, only the smaller child of a split is
counted (the other is its parent less it), and a level needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import set_checkpoint_folder

DEPTH = 5
LEAVES = 2**DEPTH  # one bit each of 32
MAX_BINS = 255
STEP = 0.05
SHARE = 0.8  # of the rows for a tree, of the features for a node
CELLS = 1024  # values of a column of codes
BLOCK = 32_768  # rows worked on at a time
PIECE = 4_096  # rows dealt at a time
POINTS = 4_096  # values of a feature that are told apart before they are cut into bins
TASK_ROWS = 16_777_216  # at most
CHECKPOINT_ROUNDS = 10
DIRECT_PARTS = 64  # counts of more tasks than this are summed on executors first


# --- bins -------------------------------------------------------------------------


def _matrix(batch: pa.RecordBatch | pa.Array, width: int) -> np.ndarray:
    vectors = batch.column("x") if isinstance(batch, pa.RecordBatch) else batch
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), width)


def merged_points(values: np.ndarray, counts: np.ndarray, most: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their counts; above ``most`` neighbours of about equal weight are taken together."""
    values, place = np.unique(values, return_inverse=True)
    counts = np.bincount(place, weights=counts, minlength=len(values))
    if len(values) > most:
        middle = np.cumsum(counts) - counts / 2
        part = np.minimum((middle * (most / counts.sum())).astype(int), most - 1)
        last = np.flatnonzero(np.diff(part, append=most))
        values, counts = values[last], np.bincount(part, weights=counts, minlength=most)[part[last]]
    return values, counts


def cut_points(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Between all values, or as evenly as they allow when there are more than bins."""
    between = (values[:-1] + values[1:]) / 2
    if len(between) < MAX_BINS:
        return between
    stride = counts.sum() / MAX_BINS
    cuts, target, seen = [], stride, np.cumsum(counts)
    for at in range(1, len(values)):
        if abs(seen[at - 1] - target) < abs(seen[at] - target):
            cuts.append(between[at - 1])
            target += stride
    return np.array(cuts[: MAX_BINS - 1])


def _feature_cuts(vectors: DataFrame, width: int) -> tuple[list[np.ndarray], int]:
    """Cut points of every feature, from all rows, and the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.empty(0), np.empty(0))] * width
        for batch in batches:
            x = _matrix(batch, width)
            for f, (values, counts) in enumerate(found):
                more, n = np.unique(x[:, f], return_counts=True)
                found[f] = merged_points(np.concatenate([values, more]), np.concatenate([counts, n]), 2 * POINTS)
        columns = zip(*[merged_points(*points) for points in found])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), *(pa.array([c.tolist() for c in cs], pa.list_(pa.float64())) for cs in columns)], ["f", "points", "counts"])

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        points, counts = merged_points(np.concatenate(part["points"].tolist()), np.concatenate(part["counts"].tolist()), 2 * POINTS)
        return pd.DataFrame({"f": part["f"].iloc[:1], "cuts": [cut_points(points, counts).tolist()], "n": [int(counts.sum())]})

    points = vectors.select("x").mapInArrow(count, "f int, points array<double>, counts array<double>")
    rows = sorted(points.groupBy("f").applyInPandas(cut, "f int, cuts array<double>, n long").collect())  # a row per feature
    return [np.array(r["cuts"], dtype=float) for r in rows], rows[0]["n"]


class Coding:
    """Bins of all features as digits of a few columns of codes; a feature of one bin has no place."""

    def __init__(self, cuts: list[np.ndarray]):
        self.cuts, self.sizes = cuts, np.array([len(c) + 1 for c in cuts])
        self.column, self.stride, self.cells = np.full(len(cuts), -1), np.ones(len(cuts), dtype=int), []
        for f in np.argsort(-self.sizes, kind="stable"):
            if self.sizes[f] == 1:
                continue
            room = [c for c, cells in enumerate(self.cells) if cells * self.sizes[f] <= CELLS]
            if not room:
                self.cells.append(1)
            self.column[f] = room[0] if room else len(self.cells) - 1
            self.stride[f] = self.cells[self.column[f]]
            self.cells[self.column[f]] *= int(self.sizes[f])
        # The bins of all features in one row of counts.
        self.varied = np.flatnonzero(self.column >= 0)
        self.feature = np.repeat(self.varied, self.sizes[self.varied])
        ends = np.cumsum(self.sizes[self.varied])
        self.start = np.repeat(ends - self.sizes[self.varied], self.sizes[self.varied])
        self.bin = np.arange(len(self.feature)) - self.start
        self.last = self.bin == self.sizes[self.feature] - 1

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = np.zeros((len(self.cells), len(x)), dtype=np.uint16)
        for f in self.varied:
            codes[self.column[f]] += (np.searchsorted(self.cuts[f], x[:, f]) * self.stride[f]).astype(np.uint16)
        return codes

    def by_bin(self, counted: list[np.ndarray]) -> np.ndarray:
        """Counts of the cells of each column, summed to the bins of each feature."""
        parts = []
        for f in self.varied:
            cells = counted[self.column[f]]
            shape = (*cells.shape[:-1], -1, self.sizes[f], self.stride[f])
            parts.append(cells.reshape(shape).sum(axis=(-3, -1)))
        return np.concatenate(parts, axis=-1)


Splits = dict[int, tuple[int, int]]  # node of the complete tree: feature, last bin that goes left


def _kept_leaves(coding: Coding, splits: Splits) -> dict[int, np.ndarray]:
    """Per column of codes: the leaves, as bits, that each code leaves to a row.

    A split closes the leaves below its left side to what goes right; of the leaves that all
    columns leave, a row's is the lowest.
    """
    tables: dict[int, np.ndarray] = {}
    for node, (f, b) in splits.items():
        level = (node + 1).bit_length() - 1
        width = LEAVES >> level
        left = ((1 << width // 2) - 1) << ((node + 1 - (1 << level)) * width)
        column = int(coding.column[f])
        table = tables.setdefault(column, np.full(coding.cells[column], 2**LEAVES - 1, dtype=np.uint32))
        table[np.arange(len(table)) // coding.stride[f] % coding.sizes[f] > b] &= np.uint32(~left & (2**LEAVES - 1))
    return tables


def _leaf_of(codes: np.ndarray, tables: dict[int, np.ndarray]) -> np.ndarray:
    kept = np.full(codes.shape[1], 2**LEAVES - 1, dtype=np.uint32)
    for column, table in tables.items():
        kept &= table.take(codes[column])
    return np.bitwise_count(~kept & (kept - np.uint32(1))).astype(np.intp)  # zeros below the lowest bit


# --- what tasks do ----------------------------------------------------------------

Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # codes, labels of -1 and 1, margins, packed bits of drawn rows


def _drawn(n: int, share: float, *seeds: int) -> np.ndarray:
    return np.packbits(np.random.default_rng(seeds).random(n) < share)


def _coded(coding: Coding) -> Callable:
    width = len(coding.cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, len(batch), PIECE):
                piece = batch.slice(low, PIECE)
                y = piece.column("_y").to_numpy(zero_copy_only=False)
                if not np.isin(y, (0.0, 1.0)).all():
                    raise ValueError("labels are 0 and 1")
                codes = coding.encode(_matrix(piece, width))
                made = [[(part << 32) + number], [codes.tobytes()], [(2 * y - 1).astype(np.int8).tobytes()]]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, (pa.int64(), pa.binary(), pa.binary()))], ["id", "codes", "y"])

    return run


def _first_blocks(columns: int, share: float, seed: int) -> Callable:
    def block(parts: list, partition: int, number: int) -> Block:
        y = np.concatenate([np.frombuffer(p["y"], np.int8) for p in parts])
        codes = np.concatenate([np.frombuffer(p["codes"], np.uint16).reshape(columns, len(p["y"])) for p in parts], axis=1)
        return codes, y, np.zeros(len(y)), _drawn(len(y), share, seed, 0, partition, number)

    def run(partition: int, rows: Iterable) -> Iterator[Block]:
        parts, n, number = [], 0, 0
        for row in rows:
            if parts and n + len(row["y"]) > BLOCK:
                yield block(parts, partition, number)
                parts, n, number = [], 0, number + 1
            parts.append(row)
            n += len(row["y"])
        if parts:
            yield block(parts, partition, number)

    return run


def _next_blocks(coding: Coding, splits: Splits, values: np.ndarray, share: float, seed: int, turn: int) -> Callable:
    """Margins with one more tree, and the rows drawn for the tree after it."""

    def run(partition: int, blocks: Iterable[Block]) -> Iterator[Block]:
        tables = _kept_leaves(coding, splits)
        for number, (codes, y, margin, _) in enumerate(blocks):
            yield codes, y, margin + values.take(_leaf_of(codes, tables)), _drawn(len(y), share, seed, turn, partition, number)

    return run


def _counts(coding: Coding, splits: Splits, level: int, asked: list[int], first: bool) -> Callable:
    """Per asked node of a level: number and sum of what the tree is fitted to, by bin; the whole node is the last entry."""
    nodes = len(asked)
    rank = np.full(1 << level, -1, dtype=np.intp)
    rank[asked] = np.arange(nodes)

    def run(blocks: Iterable[Block]) -> Iterator[np.ndarray]:
        tables = _kept_leaves(coding, splits)
        cells = [np.zeros((2, nodes * c)) for c in coding.cells]
        whole = np.zeros((2, nodes))
        for codes, y, margin, drawn in blocks:
            use = np.unpackbits(drawn, count=len(y)).view(bool)
            if level:
                at = rank.take(_leaf_of(codes, tables) >> (DEPTH - level))
                use &= at >= 0
            rows = np.flatnonzero(use)
            node = at.take(rows) if level else np.zeros(len(rows), dtype=np.intp)
            target = y.take(rows).astype(float)
            if not first:
                with np.errstate(over="ignore"):
                    target = 4 * target / (1 + np.exp(2 * target * margin.take(rows)))
            whole += np.bincount(node, minlength=nodes), np.bincount(node, weights=target, minlength=nodes)
            for column, size in enumerate(coding.cells):
                cell = codes[column].take(rows).astype(np.intp)
                if nodes > 1:
                    cell += node * size
                cells[column][0] += np.bincount(cell, minlength=nodes * size)
                cells[column][1] += np.bincount(cell, weights=target, minlength=nodes * size)
        by_bin = coding.by_bin([c.reshape(2, nodes, -1) for c in cells]) if cells else np.zeros((2, nodes, 0))
        yield np.concatenate([by_bin, whole[..., None]], axis=-1)

    return run


# --- growing ----------------------------------------------------------------------


def _best_splits(coding: Coding, counts: np.ndarray, allowed: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray] | None]:
    """Per node: feature, last bin on the left, and number and sum on both sides; None where nothing is gained."""
    if not len(coding.feature):
        return [None] * counts.shape[1]
    bins, whole = counts[..., :-1], counts[..., -1:]
    run = np.cumsum(bins, axis=-1)
    left = run - (run[..., coding.start] - bins[..., coding.start])
    right = whole - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = left[1] ** 2 / left[0] + right[1] ** 2 / right[0]
        before = (whole[1] ** 2 / whole[0])[:, 0]
    score = np.where(allowed & ~coding.last & (left[0] > 0) & (right[0] > 0), score, -np.inf)
    found = []
    for node, at in enumerate(score.argmax(axis=1)):
        gains = score[node, at] - before[node] > 1e-13 * score[node, at]  # rounding is no gain
        found.append((int(coding.feature[at]), int(coding.bin[at]), left[:, node, at], right[:, node, at]) if gains else None)
    return found


def _grow(blocks: RDD, coding: Coding, first: bool, n_features: int, rng: np.random.Generator) -> tuple[Splits, np.ndarray]:
    """One tree: its splits and the mean of each of its leaves."""
    splits: Splits = {}
    values = np.zeros(LEAVES)
    asked, parents = [0], {}
    depth = 1 if blocks.getNumPartitions() <= DIRECT_PARTS else 2
    for level in range(DEPTH):
        counted = blocks.mapPartitions(_counts(coding, splits, level, asked, first)).treeReduce(np.add, depth)
        known = dict(zip(asked, counted.swapaxes(0, 1)))
        if level:
            known |= {at ^ 1: parents[at >> 1] - known[at] for at in asked}
        elif known[0][0, -1]:
            values[:] = known[0][1, -1] / known[0][0, -1]
        at = sorted(known)
        allowed = np.zeros((len(at), len(coding.cuts)), dtype=bool)
        for row in allowed:
            row[rng.choice(len(row), n_features, replace=False)] = True
        found = _best_splits(coding, np.stack([known[a] for a in at], axis=1), allowed[:, coding.feature])
        asked, parents = [], {a: known[a] for a in at}
        width = LEAVES >> level + 1
        for node, best in zip(at, found):
            if best is None:
                continue
            feature, last, left, right = best
            splits[(1 << level) - 1 + node] = (feature, last)
            for child, (n, s) in ((2 * node, left), (2 * node + 1, right)):
                values[child * width : (child + 1) * width] = s / n
            asked.append(2 * node + int(right[0] < left[0]))
        if not asked:
            break
    return splits, values


def _remove_checkpoint(blocks: RDD | None) -> None:
    file = blocks.getCheckpointFile() if blocks is not None else None
    if file:
        path = blocks.context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(blocks.context._jsc.hadoopConfiguration()).delete(path, True)


def fit(rows: DataFrame, iterations: int, seed: int, share: float = SHARE, side_by_side: int = 1) -> BoostedTrees:
    """Trees for the vectors ``_x`` and the labels ``_y`` (0 or 1) of ``rows``, which are read twice.

    Of ``side_by_side`` fits each takes its part of the cores: a task of a level is short, so that its
    start counts, and tasks beyond the cores would only wait.
    """
    sc = rows.sparkSession.sparkContext
    set_checkpoint_folder(rows.sparkSession)
    vectors = rows.select(vector_to_array("_x").alias("x"), "_y")
    width = len(vectors.first()["x"])
    cuts, n = _feature_cuts(vectors, width)
    coding = Coding(cuts)
    # Blocks are dealt evenly and in an order of their own, however the rows lie.
    parts = max(min(-(-sc.defaultParallelism // side_by_side), -(-n // BLOCK)), -(-n // TASK_ROWS))
    coded = vectors.mapInArrow(_coded(coding), "id long, codes binary, y binary").repartition(parts).sortWithinPartitions("id")
    blocks = coded.rdd.mapPartitionsWithIndex(_first_blocks(len(coding.cells), share, seed)).persist(StorageLevel.MEMORY_AND_DISK)
    rng = np.random.default_rng(seed)
    trees, before, saved = [], None, None
    for turn in range(iterations):
        splits, values = _grow(blocks, coding, not turn, int(np.ceil(share * width)), rng)
        values *= STEP if turn else 1.0
        trees.append((splits, values))
        # These blocks were made and kept by the tree's first job; the ones before are not needed again.
        if before is not None:
            before.unpersist()
        if blocks.is_checkpointed:
            _remove_checkpoint(saved)
            saved = blocks
        before = blocks
        if turn + 1 < iterations:
            blocks = before.mapPartitionsWithIndex(_next_blocks(coding, splits, values, share, seed, turn + 1)).persist(StorageLevel.MEMORY_AND_DISK)
            if (turn + 1) % CHECKPOINT_ROUNDS == 0:
                blocks.checkpoint()
    blocks.unpersist()
    _remove_checkpoint(saved)
    return BoostedTrees.of(coding, trees)


# --- the model --------------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Complete trees: a node without a split has the feature -1, and the first of its leaves holds its value."""

    n_features: int
    features: np.ndarray  # (trees, nodes)
    thresholds: np.ndarray  # (trees, nodes): up to it a row goes left
    values: np.ndarray  # (trees, leaves), weighted

    @classmethod
    def of(cls, coding: Coding, trees: list[tuple[Splits, np.ndarray]]) -> BoostedTrees:
        features, thresholds = np.full((len(trees), LEAVES - 1), -1), np.zeros((len(trees), LEAVES - 1))
        for i, (splits, _) in enumerate(trees):
            for node, (f, b) in splits.items():
                features[i, node], thresholds[i, node] = f, coding.cuts[f][b]
        return cls(len(coding.cuts), features, thresholds, np.array([v for _, v in trees]))

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """From rows of features to probabilities."""
        coding = Coding([np.unique(self.thresholds[self.features == f]) for f in range(self.n_features)])
        tables = []
        for features, thresholds in zip(self.features, self.thresholds):
            nodes = np.flatnonzero(features >= 0).tolist()
            tables.append(_kept_leaves(coding, {i: (features[i], np.searchsorted(coding.cuts[features[i]], thresholds[i])) for i in nodes}))

        def score(x: np.ndarray) -> np.ndarray:
            codes = coding.encode(x).astype(np.intp)
            margin = np.zeros(len(x))
            for table, values in zip(tables, self.values):
                margin += values.take(_leaf_of(codes, table))
            with np.errstate(over="ignore"):
                return 1 / (1 + np.exp(-2 * margin))

        return score

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, self.n_features, *(part[i].tolist() for part in (self.features, self.thresholds, self.values))) for i in range(len(self.values))]
        schema = "tree int, n_features int, features array<int>, thresholds array<double>, leaves array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        rows = spark.read.parquet(path).orderBy("tree").collect()  # one per tree
        return cls(rows[0]["n_features"], *(np.array([r[c] for r in rows]) for c in ("features", "thresholds", "leaves")))


def probabilities(models: list[BoostedTrees], x: Column) -> Column:
    """The probability of each model for a vector of features, as an array."""
    width = models[0].n_features

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorers = [m.scorer() for m in models]
        for batch in batches:
            rows = _matrix(batch, width)
            scores = np.stack([s(rows) for s in scorers], axis=1)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(scorers), pa.int32()), pa.array(scores.ravel()))

    return score(vector_to_array(x))
