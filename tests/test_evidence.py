"""Retrieval and verification on small corpora."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.operators import retrieval as rt
from tidewatch.operators import verification as vf
from tidewatch.sources import corpus as cp

DOCS = [
    (1, "Bridge closed after storm", "Engineers closed the Harbour 9 bridge in May 2021 after a storm damaged two pillars.", "https://www.wire.example/bridge"),
    (2, "Road works planned", "A plan for road works lists several roads and their contractors.", "https://agency.example/roads"),
    (3, "Tap water rumour debunked", "Claims that tap water holds tracking dust are false. The rumour was debunked.", "https://check.example/water"),
    (4, "Shop opens second floor", "The shop opened a second floor with garden tools.", "https://blog.example/shop"),
]
SOURCES = [("wire.example", 0.95), ("agency.example", 0.9), ("check.example", 0.88)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, text string, url string")


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "domain string, credibility_weight double")


def claims(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "claim_id long, text string")


def test_tokens_keep_negation(spark):
    got = spark.range(1).select(tx.tokens(F.lit("The firm did NOT recall it, Été 9"))).first()[0]
    assert "not" in got and "the" not in got and got == ["firm", "did", "not", "recall", "t", "9"]


def test_bm25_against_a_plain_loop(spark, docs):
    asked = claims(spark, "bridge bridge storm 2021", "", "nothing shared zzz", "the")
    got = {(r["claim_id"], r["doc_id"]): (r["bm25_score"], r["rank"]) for r in rt.bm25(asked, docs).collect()}
    tokens = {d: [t for t in __import__("re").findall("[a-z0-9]+", f"{t} {x}".lower()) if t not in __import__("tidewatch.functions.fixed_values", fromlist=["x"]).STOPWORDS] for d, t, x, _ in DOCS}
    avg = sum(map(len, tokens.values())) / len(tokens)
    want = {}
    for d, words in tokens.items():
        score = 0.0
        for t in ["bridge", "bridge", "storm", "2021"]:
            tf, df = words.count(t), sum(t in w for w in tokens.values())
            if tf:
                score += math.log(1 + (len(tokens) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / avg))
        if score:
            want[(0, d)] = score
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want, abs=1e-8)
    assert got[(0, 1)][1] == 1


def test_vectors_are_unit_and_topk_is_exact(spark):
    rng = np.random.default_rng(0)
    docs = rng.normal(size=(300, 16))
    docs[100:140] = docs[0]  # equal vectors: ties go to the lower id
    queries = rng.normal(size=(7, 16))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "doc_id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, vector array<double>")
    for block in (2048, 3):
        rows = rt.vector_topk(q, d, 20, dim=None, block=block).collect()
        got = {(r["query_id"], r["rank"]): r["doc_id"] for r in rows}
        sims = np.round((queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (docs / np.linalg.norm(docs, axis=1, keepdims=True)).T, 9)
        for i in range(7):
            order = np.lexsort((np.arange(300), -sims[i]))[:20]
            assert [got[(i, n + 1)] for n in range(20)] == order.tolist()


def test_hash_embedding(spark):
    df = spark.createDataFrame([(1, "alpha beta beta gamma"), (2, ""), (3, "beta gamma alpha beta")], "id long, text string")
    got = {r["id"]: dict(zip(r["vector"]["buckets"], r["vector"]["weights"])) for r in rt.hash_embed(df, "id", F.col("text")).collect()}
    assert got[2] == {} and got[1] == got[3]
    assert sum(w * w for w in got[1].values()) == pytest.approx(1.0)


def test_fusion_rewards_agreement_and_weights(spark):
    def ranking(ids):
        return spark.createDataFrame([(0, d, i + 1) for i, d in enumerate(ids)], "claim_id long, doc_id long, rank int")

    both = rt.rrf([("a", ranking([5, 1, 2]), 1.0), ("b", ranking([5, 3, 4]), 1.0)]).orderBy(F.desc("rrf_score")).first()
    assert both["doc_id"] == 5 and both["a_rank"] == both["b_rank"] == 1
    scores = {r["doc_id"]: r["rrf_score"] for r in rt.rrf([("a", ranking([1]), 3.0), ("b", ranking([2]), 1.0)]).collect()}
    assert scores[1] == pytest.approx(3 / 61) and scores[2] == pytest.approx(1 / 61)


def test_credibility_turns_the_order(spark):
    same = [(1, "T", "tap water holds dust", "https://low.example/1"), (2, "T", "tap water holds dust", "https://high.example/2")]
    docs = spark.createDataFrame(same, "doc_id long, title string, text string, url string")
    src = spark.createDataFrame([("low.example", 0.1), ("high.example", 0.95)], "domain string, credibility_weight double")
    asked = claims(spark, "does tap water hold dust")
    first = lambda use: rt.hybrid_search(asked, docs, src, 2, use_credibility=use).filter("hit_rank = 1").first()["doc_id"]
    assert first(False) == 1 and first(True) == 2


def test_verdicts(spark, docs, sources):
    asked = claims(spark, "The Harbour 9 bridge was closed in May 2021", "Tap water holds tracking dust", "Zorbulon flarn wobble", "", "  ")
    rows = {r["claim_id"]: r for r in vf.verify(asked, docs, sources, min_confidence=0.1).collect()}
    assert rows[0]["label"] in ("supported", "disputed") and rows[0]["evidence"]
    assert rows[1]["label"] == "refuted" and rows[1]["refute"] > rows[1]["support"]
    assert rows[2]["label"] == "insufficient_evidence" and rows[2]["confidence"] == 0.0
    for blank in (3, 4):
        assert rows[blank]["label"] == "insufficient_evidence" and rows[blank]["citations"] == []
    urls = {d[3] for d in DOCS}
    assert all(set(r["citations"]) <= urls for r in rows.values())
    assert rows[0]["model_versions"]["stance"]


def test_empty_corpus(spark, docs, sources):
    row = vf.verify(claims(spark, "anything at all"), docs.filter("false"), sources).first()
    assert (row["label"], row["confidence"], row["citations"]) == ("insufficient_evidence", 0.0, [])


def test_pluggable_models(spark, docs, sources):
    @F.pandas_udf("double")
    def by_length(claim: pd.Series, passage: pd.Series) -> pd.Series:
        return passage.str.len().astype(float)

    @F.pandas_udf("struct<stance:string,score:double>")
    def always(claim: pd.Series, passage: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"stance": ["entail"] * len(claim), "score": [0.9] * len(claim)})

    row = vf.verify(claims(spark, "bridge"), docs, sources, stance=always, reranker=by_length, evidence_k=2).first()
    longest = sorted(DOCS, key=lambda d: -len(f"{d[1]} {d[2]}"))[:2]
    assert row["citations"] == [d[3] for d in longest] and row["label"] == "supported"


@pytest.mark.parametrize("text,n", [("Short. Also short!", 1), ("This first sentence is long enough to be checked by someone. And this second one is long enough as well, surely! No.", 2)])
def test_claim_extraction(spark, text, n):
    got = vf.extract_claims(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(got) == n and (n > 1 or got[0]["text"] == text)
    assert vf.extract_claims(spark.createDataFrame([(1, text)], "doc_id long, text string"), max_claims=1, fallback_chars=5).collect()[0]["text"][:5] == text[:5]


@pytest.mark.parametrize("rating,score", [("Pants on Fire!", 12), ("Mostly False", 12), ("not false", 45), ("Half true", 40), ("Inaccurate", 85), (" TRUE ", 85), ("Unproven", 50), ("Satire", 45)])
def test_ratings(spark, rating, score):
    assert spark.range(1).select(tx.rating_score(F.lit(rating))).first()[0] == score


def test_article_fold(spark):
    rows = [(1, 0, "supported", 0.9, ["u1", "u2"]), (1, 1, "insufficient_evidence", 0.0, ["u2"]), (2, 0, "refuted", 0.8, ["u3"])]
    verdicts = spark.createDataFrame(rows, "article_id long, position int, label string, confidence double, citations array<string>")
    articles = spark.createDataFrame([(1,), (2,), (3,)], "article_id long")
    got = {r["article_id"]: r for r in vf.article_credibility(articles, verdicts).collect()}
    assert (got[1]["score"], got[1]["verdict"], got[1]["citations"]) == (72, "Credible", ["u1", "u2"])
    assert (got[2]["score"], got[2]["verdict"]) == (10, "Fake News")
    assert (got[3]["score"], got[3]["verdict"], got[3]["claims_checked"], got[3]["decisive"]) == (50, "Unverified", 0, False)


def test_corpus_reader(spark, docs, sources):
    kinds = docs.withColumns({"kind": F.when(F.col("doc_id") == 4, "draft").otherwise("article"), "ingested_at": F.timestamp_seconds("doc_id")})
    got = {r["doc_id"]: r["credibility"] for r in cp.read_corpus(kinds, sources).collect()}
    assert got == {1: 0.95, 2: 0.9, 3: 0.88}
    assert [r["doc_id"] for r in cp.read_corpus(kinds, sources, newest=1).collect()] == [3]
    assert cp.seed_sources(spark).count() == 7


def test_blocks_of_claims_give_the_same_answer(spark, docs):
    asked = claims(spark, *[f"bridge storm {w}" for w in ("roads", "water rumour", "shop garden", "2021", "dust floor", "pillars")])
    whole = {tuple(r) for r in rt.bm25(asked, docs).collect()}
    assert whole == {tuple(r) for r in rt.bm25(asked, docs, block=2).collect()}


def test_one_row_pieces_give_the_same_answer(spark, docs, monkeypatch):
    asked = claims(spark, "bridge storm 2021", "tap water dust")
    whole = [{tuple(r) for r in df.collect()} for df in (rt.bm25(asked, docs), rt.vector_topk(rt.embed_claims(asked), rt.embed_docs(docs)))]
    monkeypatch.setattr(rt, "CELLS", 1)
    assert whole == [{tuple(r) for r in df.collect()} for df in (rt.bm25(asked, docs), rt.vector_topk(rt.embed_claims(asked), rt.embed_docs(docs)))]
