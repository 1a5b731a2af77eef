"""Blocks of queries and units: the same answer, and no broadcast is left behind."""

import os

import numpy as np
import pytest
from pyspark import SparkContext

from tests.test_clustering import check, sparse
from tidewatch.operators import clustering, retrieval


@pytest.fixture
def made(monkeypatch):
    paths, broadcast = [], SparkContext.broadcast

    def keep(self, value):
        shared = broadcast(self, value)
        paths.append(shared._path)
        return shared

    monkeypatch.setattr(SparkContext, "broadcast", keep)
    return paths


def test_blocks_of_queries_free_their_broadcasts(spark, made):
    docs = spark.createDataFrame([(i, "", f"storm bridge {i % 7} water {i % 5}") for i in range(40)], "doc_id long, title string, text string")
    asked = spark.createDataFrame([(i, f"bridge {i % 7} water") for i in range(12)], "claim_id long, text string")
    whole = {tuple(r) for r in retrieval.bm25(asked, docs, 5).collect()}
    made.clear()
    blocks = retrieval.bm25(asked, docs, 5, block=2)
    assert not made  # more claims than a block: answered from the written index
    assert {tuple(r) for r in blocks.collect()} == whole
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(1).normal(size=(50, 4)))], "doc_id long, vector array<double>")
    queries = vectors.limit(12).withColumnRenamed("doc_id", "query_id")
    whole = {tuple(r) for r in retrieval.vector_topk(queries, vectors, 5, dim=None).collect()}
    made.clear()
    blocks = retrieval.vector_topk(queries, vectors, 5, dim=None, block=2)
    assert len(made) > 2 and not any(map(os.path.exists, made))
    assert {tuple(r) for r in blocks.collect()} == whole


def test_pieces_of_units_free_their_broadcasts(spark, made, monkeypatch):
    monkeypatch.setattr(clustering, "CHUNK", 15)
    check(spark, sparse(np.random.default_rng(7), 60, 3), 0.1, 4)
    assert sum(map(os.path.exists, made)) <= 2  # units meet by a join; only open pairs of boxes are broadcast
