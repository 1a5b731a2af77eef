"""The written index gives the answers of a full scan, whatever its bounds leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import postings
from tidewatch.operators import retrieval as rt


def corpus(spark, n, seed):
    """Few frequent words, many rare ones, some repeated; empty and null texts; equal documents."""
    rng = np.random.default_rng(seed)
    words = np.array(["common", "usual", "often", *[f"w{i}" for i in range(200)]])
    odds = np.array([60.0, 30.0, 20.0, *(40.0 / np.arange(1, 201))])
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=odds / odds.sum())) for _ in range(n)]
    texts[3], texts[5], texts[7] = "", None, texts[8]
    return spark.createDataFrame([(i, "title", t) for i, t in enumerate(texts)], "doc_id long, title string, text string").repartition(4), words


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_index_equals_scan(spark, monkeypatch, k):
    monkeypatch.setattr(postings, "HOT_POSTINGS", 4)
    docs, words = corpus(spark, 400, 1)
    rng = np.random.default_rng(2)
    asked = [" ".join(rng.choice(words, rng.integers(1, 8))) for _ in range(25)]
    asked += ["common usual often", "common common w1", "", None, "unheard", "common unheard", "w7 w8 w9 common usual often title"]
    claims = spark.createDataFrame(list(enumerate(asked)), "claim_id long, text string")
    scan = {tuple(r) for r in rt.bm25(claims, docs, k).collect()}
    assert scan == {tuple(r) for r in rt.bm25_postings(claims, docs, k).collect()}
    index = postings.build_postings(rt.tokenised(docs), rt.K1, rt.B, by_term=True)
    assert scan == {tuple(r) for r in rt.bm25_postings(claims, docs, k, index=index).collect()}


def test_frequent_terms_are_salted_and_bounds_are_used(spark, monkeypatch):
    monkeypatch.setattr(postings, "HOT_POSTINGS", 4)
    asked = {}
    contributions = postings._contributions

    def seen(weighted, blocks):
        asked[len(asked)] = {r["term"] for r in weighted.select("term").collect()}
        return contributions(weighted, blocks)

    monkeypatch.setattr(postings, "_contributions", seen)
    docs, _ = corpus(spark, 400, 1)
    claims = spark.createDataFrame([(1, "w1 w2 w3 w4 common")], "claim_id long, text string")
    want = {tuple(r) for r in rt.bm25(claims, docs, 2).collect()}
    index = postings.build_postings(rt.tokenised(docs), rt.K1, rt.B)
    assert index.blocks.where("term = 'common'").select("salt").distinct().count() > 1
    assert index.blocks.agg(F.max(F.size("docs") - F.col("n"))).first()[0] == 0
    assert {tuple(r) for r in rt.bm25_postings(claims, docs, 2, index=index).collect()} == want
    assert "common" not in asked[1] and asked[1]  # no candidate comes from the frequent term


def test_empty_tables(spark):
    docs, _ = corpus(spark, 20, 1)
    claims = spark.createDataFrame([(1, "common")], "claim_id long, text string")
    assert rt.bm25_postings(claims.limit(0), docs).collect() == []
    assert rt.bm25_postings(claims, docs.limit(0)).collect() == []
    assert rt.bm25(claims, docs.limit(0)).collect() == []
