"""BM25 over a written inverted index.

The corpus is read twice, once for its totals and once for its postings, however many claims
are asked.  Postings lie in blocks: a block is one term with the documents of one piece of
an Arrow batch and each document's saturated term frequency, and knows its best one.  An index that will be asked
often is dealt by a hash of the term and sorted by it (``by_term``); one made for a single
question is written where the documents lie, without that shuffle.  The blocks of a frequent
term are salted, so that no task holds them all.

A claim's answer is found with the bounds the blocks carry.  Its rarest terms give a score
that the k-th best document reaches at least.  Terms that can't reach it together, even with
their best documents, bring no candidate: only documents of the other terms are scored, those
that can't reach it with all that is left are dropped, and the frequent terms are looked up
for what remains.  Answers equal those of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.pieces import pieces
from tidewatch.session import broadcast_if_small, scratch_path

BATCH_TOKENS = 2_000_000  # tokens made into blocks at a time in a task: 16 MB a number array
BLOCK_TOKENS = 20_000_000  # tokens of the corpus per partition of the index
HOT_POSTINGS = 1_000  # a block of so many documents is salted
SALTS = 16
SLACK = 1e-6  # bounds are compared with room for the rounding of sums


@dataclass
class Postings:
    """``term, docs, sats, best, n, salt`` in the shared folder, and the corpus' totals."""

    blocks: DataFrame
    n_docs: int
    avg_len: float
    k1: float
    b: float


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _to_blocks(avg_len: float, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "tokens", BATCH_TOKENS):
            tokens = batch.column("tokens")
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            words = pc.dictionary_encode(tokens.flatten())
            n_words = len(words.dictionary)
            if not n_words:
                continue
            cell, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * batch.num_rows + np.repeat(np.arange(batch.num_rows), lengths), return_counts=True)
            row, word = cell % batch.num_rows, cell // batch.num_rows
            sats = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[row] / max(avg_len, 1e-9)))
            starts = np.searchsorted(word, np.arange(n_words + 1)).astype(np.int32)
            columns = [
                words.dictionary,
                pa.ListArray.from_arrays(starts, batch.column("doc_id").take(pa.array(row))),
                pa.ListArray.from_arrays(starts, pa.array(sats)),
                pa.array(np.maximum.reduceat(sats, starts[:-1])),
                pa.array(np.diff(starts).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "docs", "sats", "best", "n"])

    return run


def build_postings(tokenised: DataFrame, k1: float, b: float, by_term: bool = False) -> Postings:
    """Index ``(doc_id, tokens, len)`` rows; documents without tokens count in the totals only."""
    n_docs, total = tokenised.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    avg_len = total / max(n_docs, 1)
    doc_type = tokenised.schema["doc_id"].dataType.simpleString()
    found = tokenised.select("doc_id", "tokens").mapInArrow(_to_blocks(avg_len, k1, b), f"term string, docs array<{doc_type}>, sats array<double>, best double, n long")
    salted = F.when(F.col("n") >= HOT_POSTINGS, F.pmod(F.xxhash64("docs"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    found = found.withColumn("salt", salted)
    if by_term:
        n_parts = max(tokenised.sparkSession.sparkContext.defaultParallelism, -(-total // BLOCK_TOKENS))
        found = found.repartition(n_parts, "term", "salt").sortWithinPartitions("term")
    return Postings(_written(found, "postings"), n_docs, avg_len, k1, b)


def _contributions(weighted: DataFrame, blocks: DataFrame) -> DataFrame:
    """``claim_id, doc_id, part``: every posting of the terms, once per claim that asks for it.

    ``weighted`` is ``claim_id, term, weight, salts``: repeated per salt of its term, so that
    the blocks of a frequent term meet their claims in several tasks.
    """
    repeated = weighted.select("claim_id", "term", "weight", F.explode(F.sequence(F.lit(0), F.col("salts") - 1).cast("array<bigint>")).alias("salt"))
    met = repeated.join(blocks.select("term", "salt", "docs", "sats"), ["term", "salt"])
    each = met.select("claim_id", "weight", F.inline(F.arrays_zip("docs", "sats")))
    return each.select("claim_id", F.col("docs").alias("doc_id"), (F.col("weight") * F.col("sats")).alias("part"))


def search(index: Postings, asked: DataFrame, k: int, digits: int) -> DataFrame:
    """``claim_id, doc_id, bm25_score`` of at least the best ``k`` documents per claim.

    ``asked`` is (claim_id, term, asked); a term that no document has adds nothing.
    """
    terms = broadcast_if_small(_written(asked.select("term").distinct(), "asked-terms"))
    blocks = _written(index.blocks.join(terms, "term", "left_semi"), "asked-postings")
    stats = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("best").alias("best"), (F.max("salt") + 1).alias("salts"))
    n, df = F.lit(float(index.n_docs)), F.col("df")
    weight = F.col("asked") * F.log(1 + (n - df + 0.5) / (df + 0.5))
    weighted = asked.join(stats, "term").select("claim_id", "term", "df", weight.alias("weight"), (weight * F.col("best")).alias("most"), "salts")
    rarest = Window.partitionBy("claim_id").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    weighted = _written(weighted.withColumn("rarer", F.coalesce(F.sum("df").over(rarest), F.lit(0))), "asked-weights")

    # a score that k documents reach
    first = _contributions(weighted.where(F.col("rarer") < k), blocks).groupBy("claim_id", "doc_id").agg(F.sum("part").alias("score"))
    placed = Window.partitionBy("claim_id").orderBy(F.desc("score"))
    reached = first.withColumn("place", F.row_number().over(placed)).where(F.col("place") <= k).groupBy("claim_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("found"))
    reached = reached.where(F.col("found") == k).select("claim_id", "low")

    # terms that can't reach it together, the weakest first
    weakest = Window.partitionBy("claim_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    bounded = weighted.join(reached, "claim_id", "left").withColumn("together", F.sum("most").over(weakest))
    bounded = _written(bounded.withColumn("essential", F.col("low").isNull() | (F.col("together") >= F.col("low") - SLACK)), "asked-bounds")
    found = _contributions(bounded.where("essential"), blocks).groupBy("claim_id", "doc_id").agg(F.sum("part").alias("score"))
    rest = bounded.where("NOT essential")
    if rest.limit(1).count():
        left = rest.groupBy("claim_id").agg(F.max("low").alias("low"), F.sum("most").alias("more"))
        found = found.join(left, "claim_id", "left").where(F.col("low").isNull() | (F.col("score") + F.col("more") >= F.col("low") - SLACK))
        found = _written(found.select("claim_id", "doc_id", "score"), "bm25-candidates")
        open_pairs = found.join(rest.select("claim_id", "term", "weight"), "claim_id").select("claim_id", "doc_id", "term", "weight")
        frequent = blocks.join(broadcast_if_small(rest.select("term").distinct()), "term", "left_semi").select("term", F.inline(F.arrays_zip("docs", "sats"))).withColumnRenamed("docs", "doc_id")
        parts = open_pairs.join(frequent, ["term", "doc_id"]).select("claim_id", "doc_id", (F.col("weight") * F.col("sats")).alias("score"))
        found = found.union(parts).groupBy("claim_id", "doc_id").agg(F.sum("score").alias("score"))
    return found.select("claim_id", "doc_id", F.round("score", digits).alias("bm25_score"))
