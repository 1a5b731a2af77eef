"""Language identification with a bidirectional gated recurrent network (operator 8).

The network reads bytes from both ends of a chunk and labels every position; a document's
probabilities are the mean over all positions of all its chunks.  It is trained in numpy by
back-propagation through time on random chunks of the whole texts of a bounded sample of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import held_out, pick, text_slices
from tidewatch.llm.sampling import Adam, chunk_matrix, chunk_places, few_of_each, train_on

CHUNK = 96
STATE = 8
PAD = 256
PER_LABEL = 400
STEPS = 300
BATCH = 64
UNKNOWN = "und"
SLICE_BYTES = 1 << 20


def _tanh(x: np.ndarray) -> np.ndarray:
    return np.tanh(x, out=x)


class _Gru:
    """One direction.  Gates: update, reset, candidate, side by side in every matrix."""

    def __init__(self, w: dict[str, np.ndarray], name: str):
        self.x, self.h, self.name = w[f"{name}_x"], w[f"{name}_h"], name

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step for time-major codes (steps, rows)."""
        h = np.zeros((codes.shape[1], STATE), np.float32)
        out = np.empty((*codes.shape, STATE), np.float32)
        for t, step in enumerate(codes):
            x, u = self.x[step], h @ self.h
            gates = x[:, : 2 * STATE] + u[:, : 2 * STATE]
            gates *= 0.5
            gates = _tanh(gates)
            gates += 1
            gates *= 0.5
            z, r = gates[:, :STATE], gates[:, STATE:]
            n = _tanh(x[:, 2 * STATE :] + r * u[:, 2 * STATE :])
            new = n + z * (h - n)
            if keep is not None:
                keep.append((step, h, z, r, n, u[:, 2 * STATE :]))
            h = out[t] = new
        return out

    def backward(self, kept: list, dout: np.ndarray) -> dict[str, np.ndarray]:
        dx, dh_w = np.zeros_like(self.x), np.zeros_like(self.h)
        dh = np.zeros_like(dout[0])
        for t in range(len(kept) - 1, -1, -1):
            step, h, z, r, n, un = kept[t]
            dh = dh + dout[t]
            dz, dn = dh * (h - n), dh * (1 - z)
            da_n = dn * (1 - n * n)
            da = np.concatenate([dz * z * (1 - z), da_n * un * r * (1 - r), da_n], axis=1)
            du = np.concatenate([da[:, : 2 * STATE], da_n * r], axis=1)
            np.add.at(dx, step, da)
            dh_w += h.T @ du
            dh = dh * z + du @ self.h.T
        return {f"{self.name}_x": dx, f"{self.name}_h": dh_w}


class LanguageNet:
    def __init__(self, languages: list[str], seed: int = 9, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        self.languages = languages
        if weights:
            self.w = weights
            return
        self.w: dict[str, np.ndarray] = {}
        for name in ("right", "left"):
            self.w[f"{name}_x"] = rng.normal(0, 0.4, (257, 3 * STATE)).astype(np.float32)
            self.w[f"{name}_h"] = rng.normal(0, STATE**-0.5, (STATE, 3 * STATE)).astype(np.float32)
        self.w["out"] = rng.normal(0, 0.3, (2 * STATE, max(1, len(languages)))).astype(np.float32)
        self.w["bias"] = np.zeros(max(1, len(languages)), np.float32)

    def positions(self, chunks: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of every position (steps, rows, languages) and the states they come from."""
        codes = chunks.T
        right = _Gru(self.w, "right").states(codes, keep and keep[0])
        left = _Gru(self.w, "left").states(codes[::-1], keep and keep[1])[::-1]
        states = np.concatenate([right, left], axis=2)
        logits = states.reshape(-1, 2 * STATE) @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*codes.shape, -1), states

    def documents(self, data: np.ndarray, ends: np.ndarray, batch: int = 2048) -> np.ndarray:
        """Mean probabilities of each text over all its positions."""
        starts, stops, doc = chunk_places(ends, CHUNK, CHUNK)
        total = np.zeros((len(ends), len(self.w["bias"])))
        for a in range(0, len(starts), batch):
            chunks = chunk_matrix(data, starts[a : a + batch], stops[a : a + batch], CHUNK, PAD)
            real = chunks != PAD
            probabilities, _ = self.positions(chunks)
            sums = np.einsum("trl,rt->rl", probabilities, real.astype(np.float32))
            np.add.at(total, doc[a : a + batch], sums)
        counts = np.bincount(doc, np.where(stops > starts, stops - starts, 0), len(ends))
        return total / np.maximum(counts, 1)[:, None]

    def gradients(self, chunks: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over real positions, through time in both directions."""
        keep: tuple[list, list] = ([], [])
        p, states = self.positions(chunks, keep)
        real = (chunks.T != PAD)[:, :, None]
        d = p.copy()
        d[:, np.arange(len(y)), y] -= 1
        d = (d * real / real.sum()).astype(np.float32)
        flat = d.reshape(-1, d.shape[2])
        ds = (flat @ self.w["out"].T).reshape(*d.shape[:2], -1)
        found = _Gru(self.w, "right").backward(keep[0], ds[:, :, :STATE])
        found |= _Gru(self.w, "left").backward(keep[1], ds[::-1, :, STATE:])
        return found | {"out": states.reshape(-1, 2 * STATE).T @ flat, "bias": flat.sum(axis=0)}


def train(texts: list[bytes], labels: list[str], steps: int = STEPS, seed: int = 9) -> LanguageNet:
    """Every step takes the same number of random chunks from each language."""
    languages = sorted(set(labels))
    net, rng = LanguageNet(languages, seed), np.random.default_rng(seed)
    groups = [[t for t, v in zip(texts, labels) if v == lang and t] for lang in languages]
    if sum(map(bool, groups)) < 2:
        return net
    adam = Adam(net.w, 0.02)
    filled = [i for i, g in enumerate(groups) if g]
    for step in range(steps):
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        y = rng.permutation(np.resize(np.array(rng.permutation(filled)), max(BATCH, len(filled))))
        parts = []
        for lang in y:
            text = groups[lang][rng.integers(len(groups[lang]))]
            at = rng.integers(max(1, len(text) - CHUNK + 1))
            parts.append(text[at : at + CHUNK])
        ends = np.cumsum([len(p) for p in parts])
        chunks = chunk_matrix(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, CHUNK, PAD)
        found = net.gradients(chunks, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        adam.step({k: g * min(1.0, 1.0 / (norm + 1e-9)) for k, g in found.items()})
    return net


def fit(docs: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS) -> LanguageNet:
    """Learn from at most ``per_label`` texts of each language, held-out ids left aside."""
    rows = pick(docs, doc_id="long", text="string", lang="string").where(~held_out(F.col("doc_id")))
    sample = few_of_each(rows.where("text IS NOT NULL").select("text", F.col("lang").alias("label")), per_label, "text")

    def run(texts: list[bytes], labels: list[str]) -> dict[str, np.ndarray]:
        net = train(texts, labels, steps)
        return net.w | {"languages": np.array(net.languages, dtype=np.str_)}

    weights = train_on(sample, per_label, run)
    return LanguageNet([str(v) for v in weights.pop("languages")], weights=weights)


def predict_languages(docs: DataFrame, net: LanguageNet) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, each text read whole.

    A null text, one without a letter, and any text when no language was learned, is ``und``
    with score 0; ties go to the first language by name; a null doc_id stays null and is
    held out or not like the text ''; repeated rows are answered alike; an empty table gives
    no rows; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, ends in text_slices(batch.column(1), SLICE_BYTES):
                lettered = batch.column(2)[first:stop].to_numpy(zero_copy_only=False).astype(bool) & bool(net.languages)
                probabilities = net.documents(data, ends)
                best = probabilities.argmax(axis=1)
                names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                score = np.where(lettered, np.clip(probabilities.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:stop], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = pick(docs, doc_id="long", text="string").select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    found = rows.mapInArrow(scan, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
