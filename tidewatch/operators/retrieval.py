"""Evidence retrieval: BM25, hashed vectors, exact vector top-k, rank fusion.

All claims are scored together, in blocks of bounded size.  The corpus is the big
side: its documents are scored where they lie and are never shuffled; only the
best candidates per claim and task travel further.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.functions import text as tx
from tidewatch.functions.scoring import let
from tidewatch.operators import postings
from tidewatch.operators.pieces import pieces
from tidewatch.session import broadcast_if_small, cut_lineage, gathered
from tidewatch.sources.corpus import with_credibility

K1, B = 1.5, 0.75
RRF_K = 60
POOL = 50
DIM = 768
QUERY_BLOCK = 2048  # query vectors broadcast at a time: 2048 x 768 doubles are 12 MB
ASKED_BLOCK = 100_000  # (claim, term) pairs broadcast at a time
CELLS = 1_000_000  # scores, or numbers of vectors, worked on at a time in a task: 8 MB
KNOWN_WORDS = 200_000  # whose hashes a task keeps: 50 MB
SCORE_DIGITS = 9  # ranks must not depend on the last bits of a float sum


def searchable(title: Column, text: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))))


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """Best k per group.  Spark limits each partition to k before the shuffle."""
    best_first = Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(rank, F.row_number().over(best_first)).filter(F.col(rank) <= k)


# --- scanning the corpus -----------------------------------------------------------


class _RunningTopK:
    """Best k documents per query over the batches of one task, ties to the lower id.

    All queries are merged at once: a merge sorts what the touched queries hold and what is new.
    """

    def __init__(self, query_ids: np.ndarray, k: int, positive_only: bool):
        self.query_ids, self.k, self.positive_only = query_ids, k, positive_only
        self.columns, self.scores = np.zeros(0, np.int64), np.zeros(0)
        self.ids: np.ndarray | None = None
        self.floor = np.full(len(query_ids), -np.inf)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` is (rows, queries), not yet rounded; rows below a query's k-th best so far are left at once."""
        floor = self.floor - 10.0**-SCORE_DIGITS  # what rounding can't lift to the k-th best
        if self.ids is None and len(scores) > self.k:  # the k-th best of the first rows
            floor = np.partition(scores, -self.k, axis=0)[-self.k] - 10.0**-SCORE_DIGITS
        hit = scores >= floor
        if self.positive_only:
            hit &= scores > 0
        rows, columns = np.nonzero(hit)
        self.add_pairs(ids[rows], columns, np.round(scores[rows, columns], SCORE_DIGITS))

    def add_pairs(self, ids: np.ndarray, columns: np.ndarray, values: np.ndarray) -> None:
        """Single (document, query, score) triples, ``columns`` being the queries' places."""
        good = values >= self.floor[columns]
        if self.positive_only:
            good &= values > 0
        ids, columns, values = ids[good], columns[good], values[good]
        if self.ids is None:
            self.ids = ids[:0]
        if not len(ids):
            return
        touched = np.zeros(len(self.query_ids), bool)
        touched[columns] = True
        old = touched[self.columns]
        ids, columns, values = (
            np.concatenate(pair) for pair in ((self.ids[old], ids), (self.columns[old], columns), (self.scores[old], values))
        )
        by = np.lexsort((ids, -values, columns))
        ids, columns, values = ids[by], columns[by], values[by]
        starts = np.flatnonzero(np.append(True, columns[1:] != columns[:-1]))
        place = np.arange(len(columns)) - np.repeat(starts, np.diff(np.append(starts, len(columns))))
        last = place == self.k - 1
        self.floor[columns[last]] = values[last]
        best = place < self.k
        self.ids, self.columns, self.scores = (
            np.concatenate(pair)
            for pair in ((self.ids[~old], ids[best]), (self.columns[~old], columns[best]), (self.scores[~old], values[best]))
        )

    def batches(self, names: list[str], id_type: pa.DataType, query_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if len(self.columns):
            by = np.argsort(self.columns, kind="stable")
            queries = pa.array(self.query_ids[self.columns[by]].tolist(), query_type)
            yield pa.RecordBatch.from_arrays([queries, pa.array(self.ids[by], id_type), pa.array(self.scores[by] + 0.0, pa.float64())], names)


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row of every element, elements) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten()


def _blocks_of(n: int, size: int) -> int:
    return max(1, math.ceil(n / size))


def _in_block(key: str, i: int, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)) == i


def _arrow_types(df: DataFrame, *columns: str) -> list[pa.DataType]:
    return [to_arrow_type(df.schema[c].dataType) for c in columns]


# --- BM25 ---------------------------------------------------------------------------

_EVERY_DOC = ""  # pseudo term: counted once per document, carries the collection totals


def query_terms(claims: DataFrame) -> DataFrame:
    """(claim_id, term, times asked): a repeated query term counts each time."""
    words = claims.select("claim_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    return words.groupBy("claim_id", "term").agg(F.count("*").alias("asked"))


def tokenised(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.tokens(searchable(F.col("title"), F.col("text"))).alias("tokens")).withColumn("len", F.size("tokens"))


def term_statistics(documents: DataFrame) -> DataFrame:
    """(term, df, total_len) of (len, tokens) rows; the pseudo term has the collection totals.

    Counted map-side: one row per distinct term and task is all that is shuffled.
    """
    seen = F.concat(F.array_distinct("tokens"), F.array(F.lit(_EVERY_DOC)))
    return documents.select("len", F.explode(seen).alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("len").alias("total_len"))


def collection_statistics(docs: DataFrame) -> DataFrame:
    """(term, df, idf, n_docs, avg_len) of every term of the corpus."""
    per_term = term_statistics(tokenised(docs))
    totals = per_term.filter(F.col("term") == _EVERY_DOC).select(
        F.lit(1).alias("_one"), F.col("df").alias("n_docs"), (F.col("total_len") / F.col("df")).alias("avg_len")
    )
    n, df = F.col("n_docs"), F.col("df")
    return (
        per_term.filter(F.col("term") != _EVERY_DOC)
        .withColumn("_one", F.lit(1))
        .join(F.broadcast(totals), "_one")  # one row
        .select("term", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"), "n_docs", "avg_len")
    )


def bm25(claims: DataFrame, docs: DataFrame, k: int = POOL, k1: float = K1, b: float = B, block: int = QUERY_BLOCK) -> DataFrame:
    """(claim_id, doc_id, bm25_score, rank): Okapi BM25, best ``k`` per claim, zero scores dropped.

    The corpus is read twice, however many claims there are.  Claims that fit one block of
    bounded size are broadcast: a first scan counts their terms, a second scores every
    document where it lies and keeps a running top-k per claim and task.  More claims are
    answered from an index that the two scans write (:mod:`tidewatch.operators.postings`).
    """
    asked = query_terms(claims)
    n_claims, n_pairs = asked.agg(F.countDistinct("claim_id"), F.count("*")).first()
    if n_claims > block or n_pairs > ASKED_BLOCK:
        return bm25_postings(claims, docs, k, k1, b)
    spark = docs.sparkSession
    corpus = tokenised(docs)
    types = _arrow_types(claims, "claim_id") + _arrow_types(docs, "doc_id")
    schema = f"claim_id {claims.schema['claim_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, bm25_score double"
    mine = asked.toPandas()
    terms = sorted(mine["term"].unique())
    stats = _asked_statistics(corpus, terms) if terms else None
    if stats is None or not stats[1]:
        return top_k(spark.createDataFrame([], schema), "claim_id", "bm25_score", "doc_id", k)
    df, n_docs, total_len = stats
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast(_AskedTerms.of(mine, terms, idf, total_len / n_docs))
    found = corpus.select("doc_id", "len", "tokens").mapInArrow(_score_terms(shared, k, k1, b, types), schema)
    return top_k(found, "claim_id", "bm25_score", "doc_id", k)


def bm25_postings(claims: DataFrame, docs: DataFrame, k: int = POOL, k1: float = K1, b: float = B, index: postings.Postings | None = None) -> DataFrame:
    """:func:`bm25` from a written index, for any number of claims; ``index`` brings one made before."""
    index = index or postings.build_postings(tokenised(docs), k1, b)
    return top_k(postings.search(index, query_terms(claims), k, SCORE_DIGITS), "claim_id", "bm25_score", "doc_id", k)


def _asked_statistics(corpus: DataFrame, terms: list[str]) -> tuple[np.ndarray, float, float]:
    """Documents per asked term, all documents and their tokens; a row per task goes to the driver."""
    shared = corpus.sparkSession.sparkContext.broadcast(pa.array(terms))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(shared.value), np.int64), 0, 0
        for batch in pieces(batches, "tokens"):
            row, words = _lists(batch.column("tokens"))
            index = pc.fill_null(pc.index_in(words, shared.value), -1).to_numpy(zero_copy_only=False)
            known = index >= 0
            cell = np.unique(row[known] * len(df) + index[known].astype(np.int64))
            df += np.bincount(cell % len(df), minlength=len(df))
            n, total = n + batch.num_rows, total + len(words)
        place = np.flatnonzero(df)
        values = np.concatenate([[n, total], df[place]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], place])), pa.array(values)], names=["place", "n"])

    found = corpus.select("tokens").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    by_place = dict(zip(found["place"], found["n"]))
    return np.array([by_place.get(i, 0) for i in range(len(terms))], float), float(by_place.get(-1, 0)), float(by_place.get(-2, 0))


@dataclass
class _AskedTerms:
    """A block of claims as an inverted list: per term the claims asking for it, with their weight."""

    claim_ids: np.ndarray
    terms: pa.Array
    start: np.ndarray  # first entry of each term, one more at the end
    claim: np.ndarray
    weight: np.ndarray
    avg_len: float

    @classmethod
    def of(cls, asked: pd.DataFrame, terms: list[str], idf: np.ndarray, avg_len: float) -> _AskedTerms:
        ids, claim = np.unique(asked["claim_id"].to_numpy(), return_inverse=True)
        term = np.searchsorted(np.array(terms), asked["term"].to_numpy(dtype=str))
        order = np.argsort(term, kind="stable")
        start = np.searchsorted(term[order], np.arange(len(terms) + 1))
        return cls(ids, pa.array(terms), start, claim[order], (asked["asked"].to_numpy() * idf[term])[order], avg_len)

    def scores(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n_rows: int) -> np.ndarray:
        """(rows, claims) sums of ``value`` times the weight of every claim asking for the posting's term."""
        times = self.start[term + 1] - self.start[term]
        entry = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times - self.start[term], times)
        cell = np.repeat(row, times) * len(self.claim_ids) + self.claim[entry]
        flat = np.bincount(cell, np.repeat(value, times) * self.weight[entry], n_rows * len(self.claim_ids))
        return flat.reshape(n_rows, len(self.claim_ids))


def _score_terms(shared, k: int, k1: float, b: float, types: list[pa.DataType]):
    cells = CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = _RunningTopK(asked.claim_ids, k, positive_only=True)
        step = max(1, cells // len(asked.claim_ids))  # documents at a time
        for whole in pieces(batches, "tokens"):
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows, words = _lists(batch.column("tokens"))
                length = batch.column("len").to_numpy(zero_copy_only=False).astype(float)
                index = pc.fill_null(pc.index_in(words, asked.terms), -1).to_numpy(zero_copy_only=False)
                known = index >= 0
                posting, tf = np.unique(rows[known] * len(asked.terms) + index[known].astype(np.int64), return_counts=True)
                row, term = posting // len(asked.terms), posting % len(asked.terms)
                saturated = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[row] / max(asked.avg_len, 1e-9)))
                scores = asked.scores(row, term, saturated, batch.num_rows)
                best.add(batch.column("doc_id").to_numpy(zero_copy_only=False), scores)
        yield from best.batches(["claim_id", "doc_id", "bm25_score"], types[1], types[0])

    return run


# --- hashed vectors --------------------------------------------------------------------


def _hash(term: str) -> int:
    return int(hashlib.md5(term.encode()).hexdigest()[:15], 16)


def hash_embed(df: DataFrame, id_col: str, text: Column, dim: int = DIM) -> DataFrame:
    """(id, vector): signed hashed bag of words, 1 + ln(tf), unit length.

    The vector is sparse, ``struct<buckets, weights>`` sorted by bucket and at most
    ``dim`` long; texts without tokens get an empty one.  Rows never leave their
    partition.
    """

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        for batch in pieces(batches, "tokens"):
            row, words = _lists(batch.column("tokens"))
            coded = pc.dictionary_encode(words)
            names = coded.dictionary.to_pylist()
            if len(known) > KNOWN_WORDS:
                known.clear()
            for t in names:
                if t not in known:
                    known[t] = (_hash(t) % dim, 1.0 if _hash(t + "#sign") % dim % 2 == 0 else -1.0)
            place = np.array([known[t] for t in names]).reshape(-1, 2)
            n_words = max(1, len(names))
            pair, tf = np.unique(row * n_words + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            word = pair % n_words
            weight = place[word, 1] * (1.0 + np.log(tf))
            cell, where = np.unique((pair // n_words) * dim + place[word, 0].astype(np.int64), return_inverse=True)
            total = np.round(np.bincount(where, weight, len(cell)).astype(float), 12)
            owner = cell // dim
            norm = np.sqrt(np.bincount(owner, total * total, batch.num_rows))[owner]
            unit = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
            offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((cell % dim).astype(np.int32), unit)]
            vector = pa.StructArray.from_arrays(lists, ["buckets", "weights"])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), vector], [id_col, "vector"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, tx.tokens(text).alias("tokens")).mapInArrow(
        embed, f"{id_col} {id_type}, vector struct<buckets:array<int>,weights:array<double>>"
    )


def _dense(column: pa.Array, dim: int | None) -> np.ndarray:
    """Unit rows out of sparse vectors, or out of plain number lists when ``dim`` is None."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if dim is None:
        row, values = _lists(column)
        width = len(values) // max(1, len(column))
        out = values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)
    else:
        out = np.zeros((len(column), dim))
        row, buckets = _lists(column.field("buckets"))
        out[row, buckets.to_numpy(zero_copy_only=False)] = column.field("weights").flatten().to_numpy(zero_copy_only=False)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


def vector_topk(queries: DataFrame, docs: DataFrame, k: int = POOL, dim: int | None = DIM, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact cosine top-k: (query_id, doc_id, vector_score, rank).

    ``queries`` is (query_id, vector), ``docs`` is (doc_id, vector): sparse when ``dim``
    is given, arrays of numbers otherwise.  There is no similarity floor.

    The corpus is scanned where it lies.  A block of query vectors (bounded size) is
    broadcast, each task keeps a running top-k per query over its Arrow batches, and
    k rows per query and task are all that is shuffled.  More queries than one block
    mean more passes, never a bigger broadcast.
    """
    spark = docs.sparkSession
    types = _arrow_types(queries, "query_id") + _arrow_types(docs, "doc_id")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, vector_score double"
    n_blocks = _blocks_of(queries.count(), block)
    if n_blocks > 1:
        queries = cut_lineage(queries)

    def parts() -> Iterator[tuple[DataFrame, Broadcast]]:
        for i in range(n_blocks):
            mine = queries if n_blocks == 1 else queries.filter(_in_block("query_id", i, n_blocks))
            table = mine.select("query_id", "vector").toArrow()
            if table.num_rows:
                shared = spark.sparkContext.broadcast((np.array(table.column("query_id").to_pylist()), _dense(table.column("vector"), dim)))
                found = docs.select("doc_id", "vector").mapInArrow(_score_vectors(shared, k, dim, types), schema)
                yield top_k(found, "query_id", "vector_score", "doc_id", k), shared  # a query is in one block

    best = gathered(parts(), "vector-topk")
    return best if best is not None else top_k(spark.createDataFrame([], schema), "query_id", "vector_score", "doc_id", k)


def _score_vectors(shared, k: int, dim: int | None, types: list[pa.DataType]):
    cells = CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best = _RunningTopK(query_ids, k, positive_only=False)
        step = max(1, cells // max(queries.shape))  # documents at a time
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                best.add(batch.column("doc_id").to_numpy(zero_copy_only=False), _dense(batch.column("vector"), dim) @ queries.T)
        yield from best.batches(["query_id", "doc_id", "vector_score"], types[1], types[0])

    return run


# --- fusion -------------------------------------------------------------------


def rrf(rankings: list[tuple[str, DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (name, (claim_id, doc_id, rank), weight) lists.

    Keeps the rank in every list as ``<name>_rank``.
    """
    names = [name for name, _, _ in rankings]
    lists = [
        df.select("claim_id", "doc_id", "rank", F.lit(name).alias("list"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
        for name, df, weight in rankings
    ]
    stacked = lists[0]
    for other in lists[1:]:
        stacked = stacked.unionByName(other)
    return stacked.groupBy("claim_id", "doc_id").agg(
        F.sum("part").alias("rrf_score"), *[F.max(F.when(F.col("list") == n, F.col("rank"))).alias(f"{n}_rank") for n in names]
    )


def embed_claims(claims: DataFrame, dim: int = DIM) -> DataFrame:
    return hash_embed(claims, "claim_id", F.col("text"), dim).withColumnRenamed("claim_id", "query_id")


def embed_docs(docs: DataFrame, dim: int = DIM) -> DataFrame:
    return hash_embed(docs, "doc_id", searchable(F.col("title"), F.col("text")), dim)


def hybrid_search(
    claims: DataFrame,
    docs: DataFrame,
    sources: DataFrame,
    top: int = 10,
    use_credibility: bool = True,
    pool: int = POOL,
    weights: tuple[float, float] = (1.0, 1.0),
    vectors: tuple[DataFrame, DataFrame] | None = None,
    dim: int | None = DIM,
) -> DataFrame:
    """(claim_id, doc_id, score, hit_rank, bm25_rank, vector_rank, url, source_domain, credibility).

    ``vectors`` brings (queries, docs) embeddings of another model; the default is
    the hashed bag of words.  The hits are written once (checkpoint), so that their
    real size decides how the documents' columns are joined to them.
    """
    query_vectors, doc_vectors = vectors or (embed_claims(claims), embed_docs(docs))
    lexical = bm25(claims, docs, pool)
    dense = vector_topk(query_vectors, doc_vectors, pool, dim).withColumnRenamed("query_id", "claim_id")
    fused = cut_lineage(rrf([("bm25", lexical, weights[0]), ("vector", dense, weights[1])]))
    # Only the key and the address of the documents are read here, not their text.
    cited = with_credibility(docs.select("doc_id", "url").join(broadcast_if_small(fused), "doc_id"), sources)
    nudge = 0.5 + 0.5 * F.col("credibility") if use_credibility else F.lit(1.0)
    scored = cited.withColumn("score", F.round(F.col("rrf_score") * nudge, 12))
    return top_k(scored, "claim_id", "score", "doc_id", top, "hit_rank")


def with_text(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Title and text of the hits; the hits are the small side."""
    return docs.select("doc_id", "title", "text").join(broadcast_if_small(hits), "doc_id")


def rerank(pairs: DataFrame, scorer, k: int = 8, max_chars: int | None = None) -> DataFrame:
    """Re-order (claim_text, title, text) hits by a pair scorer, best ``k`` per claim.

    ``scorer`` takes two columns, claim and passage, and gives a number: a Pandas UDF
    around a model, or a native expression such as :func:`overlap_scorer`.  Whole
    passages are read unless ``max_chars`` is given.
    """
    passage = searchable(F.col("title"), F.col("text"))
    if max_chars is not None:
        passage = F.left(passage, F.lit(max_chars))
    scored = pairs.withColumn("rerank_score", scorer(F.col("claim_text"), passage))
    order = Window.partitionBy("claim_id").orderBy(F.desc("rerank_score"), F.asc("hit_rank"))
    return scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).withColumn("hit_rank", F.col("_r")).drop("_r")


def overlap_scorer(claim: Column, passage: Column) -> Column:
    """Share of the claim's distinct tokens that the passage holds."""
    asked = F.array_distinct(tx.tokens(claim))
    return F.round(let(asked, lambda a: F.size(F.array_intersect(a, tx.tokens(passage))) / F.greatest(F.size(a), F.lit(1))), 6)
