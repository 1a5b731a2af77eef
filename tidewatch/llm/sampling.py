"""Bounded training samples of labelled texts."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 31
DRAW_BITS = 31


def _share(counts: dict, per_label: int, draw: Column, label: Column) -> Column:
    """True for a little more than ``per_label`` rows of each label, by their draw."""
    passes = F.lit(False)
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        share = min(1.0, (per_label + 4 * per_label**0.5 + 10) / n)
        passes = passes | ((label == F.lit(value)) & (draw <= int(share * ((1 << DRAW_BITS) - 1))))
    return passes


def draw(*key: str) -> Column:
    return F.xxhash64(F.lit(SEED), *key).bitwiseAND(F.lit((1 << DRAW_BITS) - 1))


def few_of_each(rows: DataFrame, per_label: int, *key: str) -> DataFrame:
    """Of the rows with a label, about ``per_label`` of each, chosen by a hash of the key."""
    known = rows.where("label IS NOT NULL")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return known.withColumn("draw", draw(*key)).where(_share(counts, per_label, F.col("draw"), F.col("label")))


def train_on(sample: DataFrame, per_label: int, train: Callable[[list[bytes], list], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Train on a bounded sample (``text, label, draw``) in one task and return the arrays.

    At most ``per_label`` texts of each label are used, those of the lowest draw, each of them
    whole: the bound is on rows alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for text, label, number in zip(*(c.to_pylist() for c in batch.columns)):
                found.setdefault(label, []).append((number, text))
        texts, labels = [], []
        for label in sorted(found, key=str):
            for _, text in sorted(found[label])[:per_label]:
                texts.append(text)
                labels.append(label)
        held = io.BytesIO()
        np.savez(held, **train(texts, labels))
        yield pa.RecordBatch.from_arrays([pa.array([held.getvalue()], pa.binary())], names=["model"])

    whole = sample.where("text IS NOT NULL").select(F.col("text").cast("binary").alias("text"), "label", "draw")
    model = whole.repartition(1).mapInArrow(run, "model binary").collect()
    if not model:  # an empty table has no partition that trains
        return train([], [])
    return dict(np.load(io.BytesIO(model[0]["model"]), allow_pickle=False))


class Adam:
    """Steps for a dict of float arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            mean, square = self.mean[k] / (1 - 0.9**self.t), self.square[k] / (1 - 0.999**self.t)
            self.weights[k] -= (self.rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)


def chunk_places(ends: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of the chunks that cover texts laid end to end.

    Chunks of one text overlap by ``size - step``; the last ends with the text.  An empty
    text has one empty chunk.
    """
    begins = np.concatenate([[0], ends[:-1]])
    lengths = ends - begins
    per = np.maximum(1, -(-(lengths - size) // step) + 1)
    doc = np.repeat(np.arange(len(ends)), per)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    starts = begins[doc] + np.minimum(within * step, np.maximum(lengths[doc] - size, 0))
    return starts, np.minimum(starts + size, ends[doc]), doc


def chunk_matrix(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int, pad: int) -> np.ndarray:
    """Chunks as rows of byte values, filled up with ``pad``."""
    at = starts[:, None] + np.arange(size)
    out = np.full(at.shape, pad, np.int64)
    inside = at < stops[:, None]
    out[inside] = data[at[inside]]
    return out
