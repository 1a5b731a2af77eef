"""Evidence corpus: documents with the credibility of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.session import broadcast_if_small

DEFAULT_CREDIBILITY = 0.5


def url_domain(url: Column) -> Column:
    """Host without scheme and ``www.``; case and port are kept."""
    return F.regexp_extract(url, r"^(?:https?://(?:www\.)?)?([^/]*)", 1)


def seed_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.SEED_SOURCES), "domain string, publisher string, credibility_weight double")


def with_credibility(documents: DataFrame, sources: DataFrame, url_col: str = "url") -> DataFrame:
    """Left join on the document's domain; unknown sources get the middle weight."""
    known = sources.select(F.col("domain").alias("source_domain"), F.col("credibility_weight").alias("_weight"))
    joined = documents.withColumn("_key", url_domain(F.col(url_col))).join(
        broadcast_if_small(known), F.col("_key") == F.col("source_domain"), "left"
    )
    return joined.withColumn("credibility", F.coalesce("_weight", F.lit(DEFAULT_CREDIBILITY))).drop("_key", "_weight")


def read_corpus(documents: DataFrame, sources: DataFrame, newest: int | None = None) -> DataFrame:
    """Evidence and article documents with credibility; all of them unless ``newest`` is given."""
    corpus = documents.filter(F.col("kind").isin("evidence", "article"))
    if newest is not None:
        corpus = corpus.orderBy(F.desc("ingested_at"), "doc_id").limit(newest)
    return with_credibility(corpus, sources)
