"""Registered retrieval and verification queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions import scoring as sc
from tidewatch.functions import text as tx
from tidewatch.operators import lsh
from tidewatch.operators import retrieval as rt
from tidewatch.operators import verification as vf
from tidewatch.plans import oracle_sql as osql
from tidewatch.plans import text_queries as tq
from tidewatch.plans.standins import AS_OF, table, view, with_views
from tidewatch.session import cut_lineage
from tidewatch.sources import sinks

QUERIES = {}
ORACLES = {}


def _register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


def _dec(expr: str, digits: int) -> str:
    return f"round(({expr})::DECIMAL(38,12), {digits})::DOUBLE"


def _inputs(s, sf):
    return view(s, sf, "v_claims"), view(s, sf, "v_corpus", spread=True), view(s, sf, "v_sources")


# Oracle CTEs: tokens, BM25, hashed vectors, fusion.  ``claims`` must hold (claim_id, text).


def _hash_sql(t: str) -> str:
    return f"(('0x' || substr(md5({t}), 1, 15))::BIGINT)"


def _embed_sql(source: str, key: str) -> str:
    return f"""SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM (
   SELECT {key}, {_hash_sql('term')} % 768 AS bucket, sum(CASE WHEN ({_hash_sql("(term || '#sign')")} % 768) % 2 = 0 THEN 1 ELSE -1 END * (1 + ln(tf))) AS w
   FROM {source} GROUP BY 1, 2)"""


_SEARCH = {
    "dt": f"SELECT doc_id, {osql.tokens('text')} AS tokens FROM v_corpus",
    "stats": "SELECT count(*)::DOUBLE AS n, sum(len(tokens))::DOUBLE / count(*) AS avg_len FROM dt",
    "dterms": "SELECT doc_id, term, count(*)::DOUBLE AS tf, max(len) AS len FROM (SELECT doc_id, unnest(tokens) AS term, len(tokens) AS len FROM dt) GROUP BY 1, 2",
    "dfs": "SELECT term, count(*)::DOUBLE AS df FROM dterms GROUP BY 1",
    "cterms": f"SELECT claim_id, term, count(*)::DOUBLE AS tf FROM (SELECT claim_id, unnest({osql.tokens('text')}) AS term FROM claims) GROUP BY 1, 2",
    "bscore": """SELECT c.claim_id, d.doc_id, round(sum(c.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * d.tf * 2.5::DOUBLE / (d.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 9) AS bm25_score
   FROM cterms c JOIN dterms d ON d.term = c.term JOIN dfs ON dfs.term = c.term CROSS JOIN stats GROUP BY 1, 2""",
    "bm": "SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY bm25_score DESC, doc_id) AS rank FROM bscore WHERE bm25_score > 0 QUALIFY rank <= 50",
    "dvec": _embed_sql("dterms", "doc_id"),
    "cvec": _embed_sql("cterms", "claim_id"),
    "dots": "SELECT c.claim_id, d.doc_id, sum(c.w * d.w) AS dot FROM cvec c JOIN dvec d ON c.bucket = d.bucket GROUP BY 1, 2",
    "vscore": """SELECT c.claim_id, d.doc_id, round(coalesce(dot, 0), 9) + 0.0 AS vector_score FROM (SELECT DISTINCT claim_id FROM claims) c CROSS JOIN v_corpus d
   LEFT JOIN dots ON dots.claim_id = c.claim_id AND dots.doc_id = d.doc_id""",
    "ve": "SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY vector_score DESC, doc_id) AS rank FROM vscore QUALIFY rank <= 50",
    "fused": """SELECT claim_id, doc_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, max(CASE WHEN l = 'b' THEN rank END) AS bm25_rank, max(CASE WHEN l = 'v' THEN rank END) AS vector_rank
   FROM (SELECT claim_id, doc_id, rank, 'b' AS l FROM bm UNION ALL SELECT claim_id, doc_id, rank, 'v' FROM ve) GROUP BY 1, 2""",
    "hits": """SELECT f.*, d.url, d.text, s.domain AS source_domain, coalesce(s.credibility_weight, 0.5) AS credibility,
    round(rrf_score * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(s.credibility_weight, 0.5)), 12) AS score,
    row_number() OVER (PARTITION BY claim_id ORDER BY round(rrf_score * (0.5::DOUBLE + 0.5::DOUBLE * coalesce(s.credibility_weight, 0.5)), 12) DESC, f.doc_id) AS hit_rank
   FROM fused f JOIN v_corpus d ON d.doc_id = f.doc_id LEFT JOIN v_sources s ON s.domain = d.domain""",
}
_PLAIN = {"claims": "SELECT claim_id, text FROM v_claims"}
_VIEWS = ["v_claims", "v_corpus", "v_sources"]


def _statistics(s, sf):
    claims, docs, _ = _inputs(s, sf)
    stats = rt.collection_statistics(docs)
    return stats.select("term", "df", sc.stable_round(F.col("idf"), 6).alias("idf"), "n_docs", sc.stable_round(F.col("avg_len"), 6).alias("avg_len"))


_register(
    "a16_collection_statistics",
    _statistics,
    with_views(_VIEWS, f"SELECT term, df::BIGINT AS df, {_dec('ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))', 6)} AS idf, n::BIGINT AS n_docs, {_dec('avg_len', 6)} AS avg_len FROM dfs CROSS JOIN stats", _PLAIN | _SEARCH),
)
_register(
    "r01_j07_t03_bm25",
    lambda s, sf: rt.bm25(*_inputs(s, sf)[:2]).withColumn("bm25_score", sc.stable_round(F.col("bm25_score"), 6)),
    with_views(_VIEWS, f"SELECT claim_id, doc_id, {_dec('bm25_score', 6)} AS bm25_score, rank::INT AS rank FROM bm", _PLAIN | _SEARCH),
)
_register(
    "r01_j07_bm25_postings",
    lambda s, sf: rt.bm25_postings(*_inputs(s, sf)[:2]).withColumn("bm25_score", sc.stable_round(F.col("bm25_score"), 6)),
    with_views(_VIEWS, f"SELECT claim_id, doc_id, {_dec('bm25_score', 6)} AS bm25_score, rank::INT AS rank FROM bm", _PLAIN | _SEARCH),
)
_register(
    "r02_hash_embed",
    lambda s, sf: sc.explode_rows(rt.embed_docs(_inputs(s, sf)[1]), ["doc_id"], F.arrays_zip("vector.buckets", "vector.weights")).select(
        "doc_id", F.col("item.buckets").alias("bucket"), (sc.stable_round(F.col("item.weights"), 6) + 0.0).alias("weight")),
    with_views(_VIEWS, f"SELECT doc_id, bucket::INT AS bucket, {_dec('w', 6)} AS weight FROM dvec", _PLAIN | _SEARCH),
)


def _label_queries(s, sf):
    """Query vectors: the mean embedding of every label, from the whole table."""
    e = table(s, sf, "embeddings")
    dims = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.round(F.avg("x"), 12).alias("x"))
    queries = means.groupBy(F.col("label").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l"))
    return queries.select("query_id", F.transform("l", lambda p: p["x"]).alias("vector")), e


def _vector_topk(s, sf):
    queries, e = _label_queries(s, sf)
    docs = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return rt.vector_topk(queries, docs, 50, dim=None).withColumn("vector_score", sc.stable_round(F.col("vector_score"), 6))


_register(
    "r03_j09_t04_vector_topk",
    _vector_topk,
    f"""
WITH m AS (SELECT label, i, round(avg(embedding[i]::DOUBLE), 12) AS x FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2),
q AS (SELECT label AS query_id, list(x ORDER BY i) AS v FROM m GROUP BY 1),
d AS (SELECT q.query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) AS vector_score FROM q CROSS JOIN embeddings e)
SELECT query_id, doc_id, {_dec('vector_score', 6)} AS vector_score, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, doc_id)::INT AS rank FROM d QUALIFY rank <= 50""",
)


def _near_vectors(s, sf):
    """Every row whose id is divisible by 50 against all rows: (queries, index, probes, documents)."""
    docs = table(s, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return queries, *lsh.fit_index(docs, dim=None, k=10), docs


def _near_recall(s, sf):
    queries, index, probes, docs = _near_vectors(s, sf)
    measured = lsh.recall(lsh.vector_topk_lsh(queries, index, 10, probes), rt.vector_topk(queries, docs, 10, dim=None))
    return measured.select("queries", "asked", (F.col("recall") >= 0.9).alias("recall_reached"))


def _near_topk(s, sf):
    queries, index, probes, _ = _near_vectors(s, sf)
    return lsh.vector_topk_lsh(queries, index, 10, probes)


_register("r03_lsh_topk", _near_topk)
_register(
    "r03_lsh_recall",
    _near_recall,
    """SELECT count(*) AS queries, CAST(sum(least(10, (SELECT count(*) FROM embeddings))) AS BIGINT) AS asked, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0""",
)
_register(
    "r04_w01_u01_rank_fusion",
    lambda s, sf: rt.rrf([
        ("bm25", rt.bm25(*_inputs(s, sf)[:2]), 1.0),
        ("vector", rt.vector_topk(rt.embed_claims(_inputs(s, sf)[0]), rt.embed_docs(_inputs(s, sf)[1])).withColumnRenamed("query_id", "claim_id"), 1.0),
    ]).withColumn("rrf_score", sc.stable_round(F.col("rrf_score"), 9)),
    with_views(_VIEWS, f"SELECT claim_id, doc_id, {_dec('rrf_score', 9)} AS rrf_score, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank FROM fused", _PLAIN | _SEARCH),
)
_register(
    "r05_j06_w02_hybrid_search",
    lambda s, sf: rt.hybrid_search(*_inputs(s, sf), top=10).select(
        "claim_id", "doc_id", "hit_rank", "bm25_rank", "vector_rank", "source_domain", "credibility", sc.stable_round(F.col("score"), 9).alias("score")),
    with_views(_VIEWS, f"""SELECT claim_id, doc_id, hit_rank::INT AS hit_rank, bm25_rank::INT AS bm25_rank, vector_rank::INT AS vector_rank, source_domain, credibility,
 {_dec('score', 9)} AS score FROM hits WHERE hit_rank <= 10""", _PLAIN | _SEARCH),
)


def _reranked(s, sf):
    claims, docs, sources = _inputs(s, sf)
    hits = rt.with_text(rt.hybrid_search(claims, docs, sources, top=20), docs)
    pairs = hits.join(claims.select("claim_id", F.col("text").alias("claim_text")), "claim_id")
    return rt.rerank(pairs, rt.overlap_scorer, 8).select("claim_id", "doc_id", "hit_rank", "rerank_score")


_OVERLAP = "round((len(list_intersect(list_distinct({c}), {d}))::DOUBLE / greatest(len(list_distinct({c})), 1))::DECIMAL(38,12), 6)::DOUBLE"
_register(
    "r06_rerank",
    _reranked,
    with_views(_VIEWS, f"""
, p AS (SELECT h.claim_id, h.doc_id, h.hit_rank, {_OVERLAP.format(c=osql.tokens('c.text'), d=osql.tokens('h.text'))} AS rerank_score
  FROM hits h JOIN claims c ON c.claim_id = h.claim_id WHERE h.hit_rank <= 20)
, o AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rerank_score DESC, hit_rank)::INT AS place FROM p)
SELECT claim_id, doc_id, place AS hit_rank, rerank_score FROM o WHERE place <= 8""", _PLAIN | _SEARCH),
)

# --- verification -------------------------------------------------------------------

_st, _score = tq.stance_sql("ct", "ht")
_VERIFY = {
    "pairs": f"SELECT h.claim_id, h.doc_id, h.url, h.hit_rank, h.credibility, {osql.tokens('c.text')} AS ct, {osql.tokens('h.text')} AS ht FROM hits h JOIN claims c ON c.claim_id = h.claim_id WHERE h.hit_rank <= 6",
    "judged": f"SELECT *, {_st} AS stance, {_score} * credibility / log2(hit_rank + 1.5::DOUBLE) AS weight FROM pairs",
    "sums": """SELECT claim_id, coalesce(sum(weight) FILTER (WHERE stance = 'entail'), 0) AS s, coalesce(sum(weight) FILTER (WHERE stance = 'contradict'), 0) AS r,
   count(*) FILTER (WHERE stance <> 'neutral') AS nd, list(url ORDER BY hit_rank) AS urls FROM judged GROUP BY 1""",
    "margins": "SELECT *, abs(s - r) / nullif(s + r, 0) AS m FROM sums",
    "confs": f"SELECT *, {_dec('least(0.99::DOUBLE, m * (1 - exp(-(s + r))))', 4)} AS conf FROM margins",
    "verdicts": f"""SELECT claim_id, s, r, urls,
   CASE WHEN nd < 1 OR s + r <= 0 THEN 'insufficient_evidence' WHEN m < 0.2 AND nd >= 2 THEN 'disputed' WHEN conf < 0.55 THEN 'insufficient_evidence' WHEN s > r THEN 'supported' ELSE 'refuted' END AS label,
   CASE WHEN nd < 1 OR s + r <= 0 THEN 0.0::DOUBLE WHEN m < 0.2 AND nd >= 2 THEN {_dec('0.5::DOUBLE + m', 4)} ELSE conf END AS confidence FROM confs""",
}


def _verified(s, sf):
    v = vf.verify(*_inputs(s, sf))
    return v.select(
        "claim_id", "label", "confidence", sc.stable_round(F.col("support"), 4).alias("support"), sc.stable_round(F.col("refute"), 4).alias("refute"),
        F.concat_ws(" ", "citations").alias("citations"))


_register(
    "v02_v03_w05_verify",
    _verified,
    with_views(_VIEWS, f"""
SELECT claim_id, label, confidence, {_dec('s', 4)} AS support, {_dec('r', 4)} AS refute, array_to_string(urls, ' ') AS citations FROM verdicts""", _PLAIN | _SEARCH | _VERIFY),
)

_CLAIMS_SQL = """SELECT {key} AS article_id, unnest(range(0, len(l)))::INT AS position, unnest(l) AS text FROM (
   SELECT {key}, CASE WHEN len({ss}) > 0 THEN {ss} ELSE [text] END AS l FROM {source})"""


def _claims_sql(source, key, cut=""):
    ss = tq.sentences_sql("text") + cut
    return _CLAIMS_SQL.format(key=key, source=source, ss=ss)


_register(
    "v01_extract_claims",
    lambda s, sf: vf.extract_claims(table(s, sf, "documents", spread=True)),
    f"""WITH c AS ({_claims_sql('documents', 'doc_id')})
SELECT article_id, position, article_id || '-' || position AS claim_id, text, 0.5::DOUBLE AS check_worthy FROM c""",
)


def _article_verdicts(s, sf):
    """The benchmark texts as articles, checked claim by claim against all documents."""
    articles = view(s, sf, "v_claims").select(F.col("claim_id").alias("article_id"), "text")
    claims = vf.extract_claims(articles, "article_id")
    # Read twice by the fold, hence written once.
    verdicts = cut_lineage(vf.verify(claims, view(s, sf, "v_corpus", spread=True), view(s, sf, "v_sources")).drop("evidence"))
    return articles, vf.article_credibility(articles, verdicts)


_ARTICLE_CLAIMS = {
    "extracted": _claims_sql("v_claims", "claim_id"),
    "claims": "SELECT article_id, position, article_id || '-' || position AS claim_id, text FROM extracted",
}
_ARTICLES = {
    "folded": """SELECT c.article_id, count(*) AS claims_checked, count(*) FILTER (WHERE label='supported') AS supported, count(*) FILTER (WHERE label='refuted') AS refuted,
   count(*) FILTER (WHERE label='insufficient_evidence') AS insufficient,
   avg(CASE label WHEN 'supported' THEN 0.5::DOUBLE + 0.5::DOUBLE * confidence WHEN 'refuted' THEN 0.5::DOUBLE - 0.5::DOUBLE * confidence ELSE 0.5::DOUBLE END) AS mean,
   flatten(list(urls ORDER BY position)) AS urls FROM claims c JOIN verdicts v ON v.claim_id = c.claim_id GROUP BY 1""",
    "art": """SELECT *, greatest(0, least(100, round_even((100 * mean)::DECIMAL(38,9), 0)))::INT AS score,
   list_filter(urls, lambda u, i: list_position(urls, u) = i) AS cited FROM folded""",
    "articles": """SELECT *, CASE WHEN refuted > 0 AND refuted >= supported THEN CASE WHEN score < 40 THEN 'Fake News' ELSE 'Misleading' END
   WHEN supported > 0 AND insufficient <= supported THEN 'Credible' ELSE 'Unverified' END AS verdict, supported + refuted > 0 AS decisive FROM art""",
}
_register(
    "v04_u02_article_credibility",
    lambda s, sf: _article_verdicts(s, sf)[1].withColumn("citations", F.concat_ws(" ", "citations")),
    with_views(_VIEWS, """
SELECT article_id, score, verdict, claims_checked, supported, refuted, insufficient, decisive, len(cited) AS n_citations, array_to_string(cited[1:12], ' ') AS citations FROM articles""",
               _ARTICLE_CLAIMS | _SEARCH | _VERIFY | _ARTICLES),
)
_FACT = {
    "kept": f"SELECT *, {tq.RATING_SQL} AS rated, row_number() OVER (PARTITION BY doc_id, claim_no ORDER BY review_id) AS n FROM v_reviews WHERE claim_no < 6 QUALIFY n <= 2",
    "fc": """SELECT doc_id, round_even(avg(rated)::DECIMAL(38,9), 0)::INT AS score, count(*) AS n_reviews, list(url ORDER BY claim_no, n)[1:8] AS links FROM kept GROUP BY 1""",
    "facts": "SELECT *, CASE WHEN score < 25 THEN 'Fake News' WHEN score < 45 THEN 'Misleading' WHEN score >= 65 THEN 'Credible' ELSE 'Unverified' END AS verdict FROM fc",
}
_register(
    "v05_fact_check",
    lambda s, sf: vf.fact_check(view(s, sf, "v_reviews")).withColumn("links", F.concat_ws(" ", "links")),
    with_views(["v_reviews"], "SELECT doc_id, score, verdict, n_reviews, array_to_string(links, ' ') AS links FROM facts", _FACT),
)


def _news(s, sf):
    articles, scored = _article_verdicts(s, sf)
    style = tq.style_rows(articles, "article_id").select("article_id", F.col("score").alias("style_score"), F.col("verdict").alias("style_verdict"))
    checked = vf.fact_check(view(s, sf, "v_reviews")).withColumnRenamed("doc_id", "article_id")
    # A third of the articles lose their citations, so that all three sources appear.
    thin = scored.withColumns({
        "citations": F.when(F.col("article_id") % 3 == 1, F.array().cast("array<string>")).otherwise(F.col("citations")),
        "decisive": F.col("decisive") & (F.col("article_id") % 3 != 1)})
    return articles, vf.source_precedence(thin, checked, style)


_NEWS = {
    "arts": "SELECT claim_id AS article_id, text FROM v_claims",
    **_FACT,
}
_NEWS_TAIL = tq.style_sql("arts", "article_id") + """,
thin AS (SELECT *, article_id % 3 = 1 AS gone FROM articles),
news AS (SELECT a.article_id, a.claims_checked, CASE WHEN f.doc_id IS NOT NULL THEN 'fact_check' WHEN gone OR (NOT decisive AND len(cited) = 0) THEN 'heuristic' ELSE 'rag_evidence' END AS score_source,
  f.score AS fs, f.verdict AS fvd, f.links, st.score AS ss, st.verdict AS sv, a.score AS rs, a.verdict AS rv, CASE WHEN gone THEN [] ELSE cited END AS cited
  FROM thin a LEFT JOIN facts f ON f.doc_id = a.article_id JOIN styled st ON st.article_id = a.article_id),
out AS (SELECT article_id, claims_checked, score_source, CASE score_source WHEN 'fact_check' THEN fs WHEN 'heuristic' THEN ss ELSE rs END AS score,
  CASE score_source WHEN 'fact_check' THEN fvd WHEN 'heuristic' THEN sv ELSE rv END AS verdict,
  array_to_string((CASE WHEN score_source = 'fact_check' THEN links ELSE cited END)[1:12], ' ') AS sources FROM news)"""
_register(
    "v06_source_precedence",
    lambda s, sf: _news(s, sf)[1].withColumn("sources", F.concat_ws(" ", "sources")),
    with_views(_VIEWS + ["v_reviews"], _NEWS_TAIL + "\nSELECT * FROM out", _ARTICLE_CLAIMS | _SEARCH | _VERIFY | _ARTICLES | _NEWS),
)


def _news_detections(s, sf):
    articles, scored = _news(s, sf)
    rows = scored.join(articles.select("article_id", tx.summary_line(F.col("text")).alias("summary")), "article_id").withColumns(
        {"ts": F.lit(AS_OF).cast("timestamp"), "tenant_id": F.col("article_id") % 5})
    return sinks.news_detections(rows).drop("ref_id")


_register(
    "v07_news_detections",
    _news_detections,
    with_views(_VIEWS + ["v_reviews"], _NEWS_TAIL + f"""
SELECT TIMESTAMP '{AS_OF}' AS ts, o.article_id % 5 AS tenant_id, 'news' AS module, verdict AS threat_type, {_dec('(100 - score)::DOUBLE / 100', 4)} AS risk_score,
 left(CASE WHEN length(t.line) > 280 THEN left(t.line, 280) || '…' ELSE t.line END, 180) AS summary
FROM out o JOIN (SELECT article_id, replace(regexp_replace(text, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g'), chr(10), ' ') AS line FROM arts) t ON t.article_id = o.article_id""",
               _ARTICLE_CLAIMS | _SEARCH | _VERIFY | _ARTICLES | _NEWS),
)
