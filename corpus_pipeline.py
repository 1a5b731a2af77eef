"""From raw documents to token files, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as
Parquet in the shared folder and reads it again as the next one's documents.

For every stage: other columns, whatever their names, come along (the last returns its own
columns); an empty table gives no rows; texts of any length are worked on whole; null texts
are texts without words; each stage's docstring says what else nulls, ties and repeats do.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontamination, jaccard_join, mixing, quality_rules, token_blocks
from tidewatch.llm.common import beside, original, table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts have no words and go; a null doc_id is not trusted but judged like
    others; rows are judged one by one, so repeated ones share their fate.
    """
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least doc_id.

    Of rows that repeat id and text one stays; of several texts of the least id the one of the
    least hash; rows without an id or without words stay.
    """
    return jaccard_join.one_of_each(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Found rows are named by doc_id and a hash of the text, so that a clean row of the same
    id stays; repeated rows go together; null ids are compared like any; null and empty texts
    stay.
    """
    found = written(decontamination.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", "text_hash"), "contaminated")
    rows, names = beside(docs, doc_id="long", text="string")
    hit = found.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    return original(rows.join(hit, rows["doc_id"].eqNullSafe(F.col("__doc")) & (F.xxhash64(rows["text"]) == F.col("__hash")), "left_anti"), names)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, each document as often as it is read.

    A null source is a source, the last one; null and empty texts have no size and are not
    taken; equal draws (rows that repeat id and text) are taken alike.
    """
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per reading of a document.

    Null ids come first, rows of one id by a hash of the text; a null or empty text has the
    end id only.
    """
    return token_blocks.token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("benchmark decontamination", clean_documents),
    ("mixing sources to target weights", mixed_documents),
    ("token-ID / binary output", token_files),
]

# The mix follows a seeded draw by Spark's own hash and the last stage a tokenizer library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
