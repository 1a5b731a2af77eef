"""Importance resampling towards a target distribution (operator 12).

Words come from the tokenizers library: an untrained ``Split`` by a regular expression over
the text with A-Z lowered gives every word with its offsets.  The words of a piece of text
are laid in one buffer, a blank between them, so that a run of n words is one slice, from the
start of its first word to the end of its last: a pair of offsets.  The CRC of a slice names
its bucket.  All documents and all target texts are counted into histograms over the
buckets; a bucket's gain is the logarithm of its share in the target over its share in the
corpus, and a document's weight is the sum of its gains.  A seeded Gumbel number is added to
the weight, and the highest scores are drawn: a sample without replacement.

A text is split once: the buckets of its features are written as a table, which both the
histogram and the weights read.  Histograms are numbers of buckets long, whatever the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.llm.common import pick, written

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_WORDS = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
PIECE_CHARS = 1 << 18
KNOWN_FEATURES = 1 << 19
ROWS_PER_RANGE = 200_000
_LOWER = {c: c + 32 for c in range(65, 91)}


class FeatureBuckets:
    """Buckets of all runs of 1 to ``most_words`` words of a text, repeats kept."""

    def __init__(self, most_words: int = MOST_WORDS, buckets: int = BUCKETS):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(PATTERN), behavior="removed", invert=True)
        self.most_words, self.buckets = most_words, buckets
        self.known: dict[str, int] = {}

    def _bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            if len(self.known) >= KNOWN_FEATURES:
                self.known.clear()
            found = self.known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about ``PIECE_CHARS`` characters, cut before an ASCII blank or at its end."""
        at = 0
        while at < len(text):
            end = at + PIECE_CHARS
            if end < len(text):
                cuts = [c for c in (text.find(" ", end), text.find("\n", end)) if c >= 0]
                end = min(cuts) if cuts else len(text)
            yield text[at:end]
            at = end

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """Number of words and buckets of all features; null has none."""
        n_words, found, carried = 0, [], []
        for piece in self._pieces(text or ""):
            split = self.split.pre_tokenize_str(piece.translate(_LOWER))
            n_words += len(split)
            if self.most_words == 1:
                found.append(np.array([self._bucket(w) for w, _ in split], np.int32))
                continue
            words = carried + [w for w, _ in split]
            buffer = " ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
            starts = np.concatenate([[0], ends[:-1] + 1])
            runs = []
            for n in range(1, self.most_words + 1):
                # runs wholly among the carried words were counted with the last piece
                for last in range(max(n - 1, len(carried)), len(words)):
                    runs.append(self._bucket(buffer[starts[last - n + 1] : ends[last]]))
            found.append(np.array(runs, np.int32))
            carried = words[-(self.most_words - 1) :]
        return n_words, np.concatenate(found) if found else np.zeros(0, np.int32)


def _features(texts: DataFrame, most_words: int, buckets: int, name: str) -> DataFrame:
    """``doc_id, text_hash, n_words, buckets`` of a table ``doc_id, text``, written in the shared folder."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = FeatureBuckets(most_words, buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, lists = [], []
                for text in part.column(2):
                    n, own = made.of(text.as_py())
                    words.append(n)
                    lists.append(own)
                ends = np.cumsum([0, *map(len, lists)])
                flat = pa.array(np.concatenate([*lists, np.zeros(0, np.int32)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "text_hash", "n_words", "buckets"])

    rows = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return written(rows.mapInArrow(split, "doc_id long, text_hash long, n_words long, buckets array<int>"), name)


def _values(column) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column end to end, and where each row starts and ends."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[offsets[0] : offsets[-1]]
    return flat, offsets - offsets[0]


def histogram(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of every bucket over all rows: tasks add up their own, the driver gets the sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0))[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    summed = features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(buckets, np.int64)
    for row in summed.collect():  # at most one row per bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln)`` of target share over corpus share, counts raised by one; whole numbers."""
    n, all_corpus, all_target = len(corpus), int(corpus.sum()), int(target.sum())
    up, down = (target + 1.0) * float(all_corpus + n), (corpus + 1.0) * float(all_target + n)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip(up.tolist(), down.tolist())], np.int64)


def _weighed(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight``."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _values(batch.column(3))
            sums = np.concatenate([[0], np.cumsum(gain[flat])])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())],
                names=["doc_id", "text_hash", "n_words", "n_features", "weight"],
            )

    return features.mapInArrow(weigh, "doc_id long, text_hash long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The seeded Gumbel number of an id in whole thousandths; a null id counts as ''."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(scored: DataFrame, n: int) -> DataFrame:
    """The rows with ``rank`` 1, 2, 3... by falling score, then smaller id.

    Rows are dealt by ranges of the order and written; the ranges' counts, a row each, give
    where a range begins.  Equal rows are folded first, so that no range is made of them.
    """
    columns = scored.columns
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    folded = scored.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    n_ranges = max(1, -(-n // ROWS_PER_RANGE))
    dealt = written(written(folded, "draw-rows").repartitionByRange(n_ranges, *order).withColumn("range", F.spark_partition_id()), "draw-ranges")
    counts = dealt.groupBy("range").agg(F.sum("copies").alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("range").alias("c_range"), earlier.alias("before"))
    within = W.partitionBy("range").orderBy(*order, "text_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(counts), dealt["range"] == counts["c_range"])  # one row per ROWS_PER_RANGE rows
    first = F.col("before") + F.coalesce(F.sum("copies").over(within), F.lit(0)) + 1
    return placed.withColumn("first", first).select(*columns, F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    most_words: int = MOST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``doc_id, text_hash, n_words, n_features, weight, score, rank`` for every row of ``docs``.

    ``target`` is any table with a ``text``.  ``percent`` of the rows with ``min_words`` words
    or more are drawn, rounded down; ``rank`` is null for the others.  Null and empty texts
    have no features and weigh 0; a null id draws as '' and comes last among equal scores,
    where rows of one id follow a hash of the text; repeated rows count each in the corpus and are drawn each; an empty target or corpus has
    a flat share; an empty ``docs`` gives no rows; other columns are ignored.  Texts of any
    length are split in pieces at blanks.
    """
    found = _features(pick(docs, doc_id="long", text="string"), most_words, buckets, "features")
    wanted = _features(pick(target, text="string").select(F.lit(None).cast("long").alias("doc_id"), "text"), most_words, buckets, "target-features")
    gain = gains(histogram(found, buckets), histogram(wanted, buckets))
    scored = _weighed(found, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored, "scores")
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    drawn = n * percent // 100
    ranked = _ranked(scored.where(able), n).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def sampled_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The drawn rows as ``doc_id, text, rank``: one per rank.

    Rows that repeat id and text are equal, so they meet their ranks as one and leave as many.
    """
    rows = pick(docs, doc_id="long", text="string").withColumn("hash", F.xxhash64("text"))
    chosen = ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias("r_doc"), "text_hash", "rank")
    same = [rows["doc_id"].eqNullSafe(chosen["r_doc"]), rows["hash"] == chosen["text_hash"]]
    once = rows.join(chosen, same, "left_semi").groupBy("doc_id", "hash").agg(F.first("text").alias("text"))
    return once.join(chosen, [once["doc_id"].eqNullSafe(chosen["r_doc"]), once["hash"] == chosen["text_hash"]]).select("doc_id", "text", "rank")
