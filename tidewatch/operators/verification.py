"""Claims to verdicts, articles to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.functions.scoring import explode_rows, stable_round
from tidewatch.operators import retrieval as rt
from tidewatch.session import broadcast_if_small, cut_lineage

CANDIDATES = 20
EVIDENCE = 6
MIN_CONFIDENCE = 0.55
MIN_EVIDENCE = 1


def extract_claims(
    articles: DataFrame, id_col: str = "doc_id", max_claims: int | None = None, fallback_chars: int | None = None
) -> DataFrame:
    """(article_id, position, claim_id, text, check_worthy): one row per checkable sentence.

    Whole texts by default; ``max_claims=12, fallback_chars=500`` bounds the answer per article.
    """
    found = tx.claims(F.col("text"), max_claims, fallback_chars)
    exploded = articles.select(F.col(id_col).alias("article_id"), F.posexplode_outer(found).alias("position", "text"))
    return exploded.select(
        "article_id",
        "position",
        F.concat_ws("-", F.col("article_id").cast("string"), F.col("position").cast("string")).alias("claim_id"),
        "text",
        F.lit(0.5).alias("check_worthy"),
    )


def lexical_stance(claim: Column, passage: Column) -> Column:
    return tx.stance(tx.tokens(claim), tx.tokens(passage))


def verdict_columns(support: Column, refute: Column, n_decisive: Column, min_confidence: float, min_evidence: int) -> dict[str, Column]:
    """Label and confidence out of the two weight sums."""
    total = support + refute
    margin = F.abs(support - refute) / F.nullif(total, F.lit(0.0))
    undecided = (n_decisive < min_evidence) | (total <= 0)
    torn = (margin < 0.2) & (n_decisive >= 2)
    confidence = stable_round(F.least(F.lit(0.99), margin * (1 - F.exp(-total))), 4)
    return {
        "label": F.when(undecided, "insufficient_evidence")
        .when(torn, "disputed")
        .when(confidence < min_confidence, "insufficient_evidence")
        .when(support > refute, "supported")
        .otherwise("refuted"),
        "confidence": F.when(undecided, 0.0).when(torn, stable_round(0.5 + margin, 4)).otherwise(confidence),
    }


def verify(
    claims: DataFrame,
    docs: DataFrame,
    sources: DataFrame,
    candidate_k: int = CANDIDATES,
    evidence_k: int = EVIDENCE,
    min_confidence: float = MIN_CONFIDENCE,
    min_evidence: int = MIN_EVIDENCE,
    stance=lexical_stance,
    reranker=None,
    vectors: tuple[DataFrame, DataFrame] | None = None,
    dim: int | None = rt.DIM,
    model_versions: dict[str, str] | None = None,
) -> DataFrame:
    """One verdict per claim with its evidence; every citation is a retrieved document.

    ``stance`` maps (claim, passage) columns to ``struct(stance, score)``; ``reranker`` is
    a pair scorer for :func:`tidewatch.operators.retrieval.rerank`.
    """
    asked = claims.filter(F.coalesce(tx.strip(F.col("text")), F.lit("")) != "")
    hits = rt.hybrid_search(asked, docs, sources, top=candidate_k, vectors=vectors, dim=dim)
    if reranker is None:
        # Without a reranker only the best hits ever need their text.
        hits = hits.filter(F.col("hit_rank") <= evidence_k)
    # Written once: the count below and the join both read it.
    pairs = rt.with_text(cut_lineage(hits), docs).join(
        broadcast_if_small(claims.select("claim_id", F.col("text").alias("claim_text"))), "claim_id"
    )
    if reranker is not None:
        pairs = rt.rerank(pairs, reranker, evidence_k)
    else:
        pairs = pairs.withColumn("rerank_score", F.lit(None).cast("double"))
    judged = pairs.withColumn("judged", stance(F.col("claim_text"), rt.searchable(F.col("title"), F.col("text"))))
    judged = judged.select(
        "claim_id", F.col("hit_rank").alias("rank"), "doc_id", "url", "title", F.left("text", F.lit(300)).alias("snippet"),
        F.col("source_domain").alias("domain"), "credibility", "judged.stance", F.col("judged.score").alias("stance_score"),
        F.col("score").alias("retrieval_score"), "rerank_score",
    ).withColumn("weight", F.col("stance_score") * F.col("credibility") / F.log2(F.col("rank") + 1.5))

    def weight_of(which: str) -> Column:
        return F.sum(F.when(F.col("stance") == which, F.col("weight")).otherwise(0.0))

    # At most evidence_k rows per claim reach this group.
    per_claim = judged.groupBy("claim_id").agg(
        weight_of("entail").alias("support"),
        weight_of("contradict").alias("refute"),
        F.count_if(F.col("stance") != "neutral").alias("n_decisive"),
        F.array_sort(F.collect_list(F.struct(*[c for c in ["rank"] + [c for c in judged.columns if c not in ("claim_id", "rank")]]))).alias("evidence"),
    )
    joined = claims.join(per_claim, "claim_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in ("support", "refute")} | {"n_decisive": F.coalesce("n_decisive", F.lit(0))}
    )
    versions = model_versions or {"stance": "lexical-overlap", "embedder": "hashed-bag-of-words"}
    return joined.withColumns(
        verdict_columns(F.col("support"), F.col("refute"), F.col("n_decisive"), min_confidence, min_evidence)
        | {
            "citations": F.filter(F.transform("evidence", lambda e: e["url"]), lambda u: u.isNotNull() & (u != "")),
            "model_versions": F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]),
        }
    ).withColumn("citations", F.coalesce("citations", F.array().cast("array<string>")))


# --- articles -------------------------------------------------------------------


def article_verdict(score: Column, supported: Column, refuted: Column, insufficient: Column) -> Column:
    return (
        F.when((refuted > 0) & (refuted >= supported), F.when(score < 40, "Fake News").otherwise("Misleading"))
        .when((supported > 0) & (insufficient <= supported), "Credible")
        .otherwise("Unverified")
    )


def _first_citations(verdicts: DataFrame, top: int) -> DataFrame:
    """(article_id, n_citations, citations): distinct addresses in claim order, the first ``top``.

    Each address is folded to its first place on the map side and each partition is
    cut to ``top`` per article, so an article with very many claims is no big group.
    """
    cited = explode_rows(verdicts, ["article_id", "position"], F.col("citations"), "place")
    first = cited.groupBy("article_id", F.col("item").alias("url")).agg(F.min(F.struct("position", "place")).alias("at"))
    counts = first.groupBy("article_id").agg(F.count("*").alias("n_citations"))
    order = Window.partitionBy("article_id").orderBy("at", "url")
    kept = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top)
    listed = kept.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("r", "url"))).alias("l"))
    return counts.join(listed, "article_id").select("article_id", "n_citations", F.transform("l", lambda e: e["url"]).alias("citations"))


def article_credibility(articles: DataFrame, verdicts: DataFrame, max_sources: int = 12) -> DataFrame:
    """(article_id, score, verdict, counts, decisive, citations) for every article.

    ``verdicts`` carries article_id and position.
    """
    lean = (
        F.when(F.col("label") == "supported", 0.5 + 0.5 * F.col("confidence"))
        .when(F.col("label") == "refuted", 0.5 - 0.5 * F.col("confidence"))
        .otherwise(0.5)
    )

    def n(label: str) -> Column:
        return F.count_if(F.col("label") == label)

    folded = verdicts.groupBy("article_id").agg(
        F.count("*").alias("claims_checked"),
        n("supported").alias("supported"),
        n("refuted").alias("refuted"),
        n("insufficient_evidence").alias("insufficient"),
        F.avg(lean).alias("mean"),
    )
    joined = articles.select("article_id").join(folded, "article_id", "left").join(_first_citations(verdicts, max_sources), "article_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("claims_checked", "supported", "refuted", "insufficient", "n_citations")}
    scored = joined.withColumns(
        counts
        | {
            # The mean of values in 0..1 needs no clipping; an article without claims reads 50.
            "score": F.coalesce(F.bround(F.round(100 * F.col("mean"), 9), 0), F.lit(50)).cast("int"),
            "citations": F.coalesce("citations", F.array().cast("array<string>")),
        }
    )
    return scored.select(
        "article_id", "score",
        article_verdict(F.col("score"), F.col("supported"), F.col("refuted"), F.col("insufficient")).alias("verdict"),
        "claims_checked", "supported", "refuted", "insufficient",
        ((F.col("supported") + F.col("refuted")) > 0).alias("decisive"), "n_citations", "citations",
    )


def fact_check(reviews: DataFrame, id_col: str = "doc_id", max_claims: int = 6, per_claim: int = 2, max_links: int = 8) -> DataFrame:
    """(id, score, verdict, links) out of a table of published reviews.

    The rating of an article is the mean over the first reviews of its first
    claims; that selection is the definition of the score.  Each partition is cut
    to ``per_claim`` rows per claim before the shuffle.
    """
    first = Window.partitionBy(id_col, "claim_no").orderBy("review_id")
    kept = (
        reviews.filter(F.col("claim_no") < max_claims)
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= per_claim)
        .withColumn("rated", tx.rating_score(F.col("rating")))
    )
    links = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("claim_no", "n", "url"))), lambda e: e["url"]), lambda u: u != "")
    folded = kept.groupBy(id_col).agg(F.avg("rated").alias("mean"), F.count("*").alias("n_reviews"), F.slice(links, 1, max_links).alias("links"))
    score = F.bround(F.round("mean", 9), 0).cast("int")
    verdict = F.when(score < 25, "Fake News").when(score < 45, "Misleading").when(score >= 65, "Credible").otherwise("Unverified")
    return folded.select(id_col, score.alias("score"), verdict.alias("verdict"), "n_reviews", "links")


def source_precedence(evidence: DataFrame, checked: DataFrame, style: DataFrame, max_sources: int = 12) -> DataFrame:
    """Published fact-checks first, then retrieved evidence, then writing style.

    All three are keyed by article_id; ``style`` has (style_score, style_verdict).  The
    style estimate is used only without decisive verdict and without citation.
    """
    c = checked.select("article_id", F.col("score").alias("fc_score"), F.col("verdict").alias("fc_verdict"), F.col("links").alias("fc_links"))
    joined = evidence.join(c, "article_id", "left").join(style, "article_id", "left")
    source = (
        F.when(F.col("fc_score").isNotNull(), "fact_check")
        .when(~F.col("decisive") & (F.size("citations") == 0), "heuristic")
        .otherwise("rag_evidence")
    )

    def pick(checked_col: str, style_col: str, own: str) -> Column:
        return (
            F.when(F.col("score_source") == "fact_check", F.col(checked_col))
            .when(F.col("score_source") == "heuristic", F.col(style_col))
            .otherwise(F.col(own))
        )

    return joined.withColumn("score_source", source).select(
        "article_id",
        pick("fc_score", "style_score", "score").alias("score"),
        pick("fc_verdict", "style_verdict", "verdict").alias("verdict"),
        "score_source",
        "claims_checked",
        F.slice(F.when(F.col("score_source") == "fact_check", F.col("fc_links")).otherwise(F.col("citations")), 1, max_sources).alias("sources"),
    )
