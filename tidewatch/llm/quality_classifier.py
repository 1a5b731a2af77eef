"""Quality classifier: a byte-level convolutional network in numpy (operator 1).

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Each byte has a
learned vector; learned filters of ``WIDTH`` bytes slide over a chunk and are max-pooled over
it.  A document has, per filter, the maximum and the mean over its chunks, and one logistic
unit makes the probability of them.  Trained by back-propagation on all chunks of the texts
of a bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import held_out, pick, text_slices
from tidewatch.llm.sampling import Adam, chunk_matrix, chunk_places, few_of_each, train_on

CHUNK, STEP = 512, 448
VECTOR, WIDTH, FILTERS = 8, 8, 24
PAD = 256
PER_LABEL = 1_000
EPOCHS = 8
PASS_AT = 0.3
SLICE_BYTES = 4 << 20


class ByteNet:
    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = weights or {
            "bytes": rng.normal(0, 0.5, (257, VECTOR)).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * VECTOR) ** -0.5, (WIDTH * VECTOR, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def pooled(self, chunks: np.ndarray, with_places: bool = False):
        """Per chunk and filter the largest response, and where it is."""
        vectors = self.w["bytes"][chunks].reshape(len(chunks), -1)
        n = chunks.shape[1] - WIDTH + 1
        windows = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * VECTOR, axis=1)[:, ::VECTOR]
        responses = (windows.reshape(-1, WIDTH * VECTOR) @ self.w["filters"]).reshape(len(chunks), n, FILTERS)
        if with_places:
            return np.maximum(responses.max(axis=1) + self.w["shift"], 0), responses.argmax(axis=1)
        return np.maximum(responses.max(axis=1) + self.w["shift"], 0)

    @staticmethod
    def document_vectors(pooled: np.ndarray, doc: np.ndarray) -> np.ndarray:
        firsts = np.flatnonzero(np.diff(doc, prepend=-1))
        counts = np.diff(np.append(firsts, len(doc)))[:, None]
        return np.concatenate([np.maximum.reduceat(pooled, firsts), np.add.reduceat(pooled, firsts) / counts], axis=1)

    def probability(self, data: np.ndarray, ends: np.ndarray, batch: int = 128) -> np.ndarray:
        """One probability per text, over all of its chunks."""
        starts, stops, doc = chunk_places(ends, CHUNK, STEP)
        pooled = np.concatenate([self.pooled(chunk_matrix(data, starts[a : a + batch], stops[a : a + batch], CHUNK, PAD)) for a in range(0, len(starts), batch)])
        logit = self.document_vectors(pooled, doc) @ self.w["out"] + self.w["bias"]
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -60, 60)))

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, y: np.ndarray, batch: int = 128) -> dict[str, np.ndarray]:
        """Of the mean cross entropy; responses pass their share on to their largest place only.

        A text may have any number of chunks: only maxima and places are held for all of them.
        """
        pooled, places = map(np.concatenate, zip(*(self.pooled(chunks[a : a + batch], with_places=True) for a in range(0, len(chunks), batch))))
        z = self.document_vectors(pooled, doc)
        p = 1 / (1 + np.exp(-(z @ self.w["out"] + self.w["bias"])))
        d = ((p - y) / len(y)).astype(np.float32)
        dz = d[:, None] * self.w["out"]
        counts = np.bincount(doc)[:, None]
        first = np.arange(len(doc))
        best = np.zeros_like(pooled)
        top = z[:, :FILTERS][doc] == pooled
        # of equal chunks the first one passes the gradient on
        for f in range(FILTERS):
            hits = first[top[:, f]]
            _, at = np.unique(doc[hits], return_index=True)
            best[hits[at], f] = 1
        dpooled = (best * dz[:, :FILTERS][doc] + (dz[:, FILTERS:] / counts)[doc]) * (pooled > 0)
        dbytes, dfilters = np.zeros_like(self.w["bytes"]), np.zeros_like(self.w["filters"])
        for a in range(0, len(chunks), batch):
            some, passed = chunks[a : a + batch], dpooled[a : a + batch]
            taken = some[np.arange(len(some))[:, None, None], places[a : a + batch, :, None] + np.arange(WIDTH)]
            vectors = self.w["bytes"][taken].reshape(len(some), FILTERS, WIDTH * VECTOR)
            spread = passed[:, :, None] * self.w["filters"].T[None]
            np.add.at(dbytes, taken.reshape(-1), spread.reshape(-1, VECTOR))
            dfilters += np.einsum("cf,cfk->kf", passed, vectors)
        return {"bytes": dbytes, "filters": dfilters, "shift": dpooled.sum(axis=0), "out": z.T @ d, "bias": d.sum(keepdims=True)}


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 5) -> ByteNet:
    """Labels weigh alike, however many rows each has; without texts the net stays as it began."""
    net, rng = ByteNet(seed=seed), np.random.default_rng(seed)
    if not texts:
        return net
    y = np.array(labels, np.float32)
    groups = [np.flatnonzero(y == v) for v in np.unique(y)]
    adam = Adam(net.w, 0.01)
    steps = max(60, epochs * len(texts) // 64)
    for step in range(steps):
        adam.rate = 0.01 * (1 - step / steps) + 0.0005
        chosen = np.concatenate([rng.choice(g, 64 // len(groups)) for g in groups])
        some = [texts[i] for i in chosen]
        data, ends = np.frombuffer(b"".join(some), np.uint8), np.cumsum([len(t) for t in some])
        starts, stops, doc = chunk_places(ends, CHUNK, STEP)
        net_gradients = net.gradients(chunk_matrix(data, starts, stops, CHUNK, PAD), doc, y[chosen])
        adam.step(net_gradients)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, epochs: int = EPOCHS) -> ByteNet:
    """Learn from at most ``per_label`` texts of each label, held-out ids left aside."""
    known = pick(labels, doc_id="long", quality="int").where("doc_id IS NOT NULL AND quality IN (0, 1)").dropDuplicates(["doc_id"])
    teach = known.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    # ids are chosen before any text is looked at: a bounded list
    ids = few_of_each(teach, per_label, "doc_id").select("doc_id", "label", "draw")
    taught = pick(docs, doc_id="long", text="string").join(F.broadcast(ids), "doc_id").select("text", "label", "draw")
    return ByteNet(train_on(taught, per_label, lambda texts, labels: train(texts, labels, epochs).w))


def score_documents(docs: DataFrame, net: ByteNet, pass_at: float = PASS_AT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, each text read whole.

    Null and empty texts are scored as one chunk of padding; a null doc_id stays null and is
    held out or not like the text ''; repeated rows score alike; an empty table gives no
    rows; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, ends in text_slices(batch.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:stop], pa.array(net.probability(data, ends), pa.float64())], names=["doc_id", "score"])

    scored = pick(docs, doc_id="long", text="string").mapInArrow(scan, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= pass_at).cast("int").alias("predicted"))
