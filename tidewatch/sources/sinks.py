"""Output tables: the unified detections and the stored e-mail analyses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions import scoring as sc
from tidewatch.operators import email as em
from tidewatch.operators.quality import guard_enums
from tidewatch.sources.stored import insert_batch, stored

DETECTION_COLUMNS = ("ts", "tenant_id", "module", "threat_type", "risk_score", "ref_id", "summary")
ANALYSIS_COLUMNS = (
    "tenant_id", "message_id", "from_display", "from_addr", "from_domain", "reply_to_addr", "return_path", "subject",
    "spf", "dkim", "dkim_domain", "dmarc", "dkim_aligned", "features", "indicators", "risk_score", "score_source", "verdict",
)


def detection_rows(df: DataFrame, module: str, threat_type: Column, risk: Column, summary: Column, ref_id: Column | None = None) -> DataFrame:
    """Any scored table as rows of the unified detection schema."""
    return df.select(
        F.col("ts"),
        F.col("tenant_id"),
        F.lit(module).alias("module"),
        threat_type.alias("threat_type"),
        sc.stable_round(risk, 4).alias("risk_score"),
        (F.lit(None).cast("string") if ref_id is None else ref_id.cast("string")).alias("ref_id"),
        summary.alias("summary"),
    )


def email_detections(analyses: DataFrame) -> DataFrame:
    sender = F.coalesce("from_addr", F.lit("unknown sender"))
    return detection_rows(
        analyses, "email", F.col("verdict"), F.col("risk_score"), F.concat(F.col("verdict"), F.lit(": "), sender), F.col("ref_id")
    )


def news_detections(articles: DataFrame) -> DataFrame:
    return detection_rows(
        articles, "news", F.col("verdict"), (100 - F.col("score")) / 100, F.left("summary", F.lit(180))
    )


def network_detections(batches: DataFrame) -> DataFrame:
    return detection_rows(
        batches, "network", F.concat(F.lower("level"), F.lit("_anomaly")), sc.triage_risk(F.col("level")), F.left("report", F.lit(180))
    )


def unify(*parts: DataFrame) -> DataFrame:
    """The modules' rows as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_detections(detections: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by module and day, so that both are pruned on read.

    The writing tasks are spread by (module, day, salt): a day that holds most of
    the rows is written by many tasks, and no task opens many folders.
    """
    dated = detections.withColumn("date", F.to_date("ts"))
    salt = F.pmod(F.xxhash64("ts", "threat_type", "ref_id", "summary"), F.lit(32))
    dated.repartition("module", "date", salt).write.mode(mode).partitionBy("module", "date").parquet(path)


def store_detections(detections: DataFrame, folder: str, batch: str) -> bool:
    """Add a batch to the stored detections; a replayed batch or row changes nothing."""
    dated = detections.select(*DETECTION_COLUMNS, F.to_date("ts").alias("date"))
    keys = ["date", *[c for c in DETECTION_COLUMNS if c != "risk_score"]]
    return insert_batch(dated, folder, batch, keys, ["risk_score"], write_detections, pruned_by="date")


def read_detections(spark: SparkSession, folder: str) -> DataFrame:
    """The stored detections; without any batch an empty table."""
    rows = stored(spark, folder)
    if rows is None:
        return spark.createDataFrame([], "ts timestamp, tenant_id int, module string, threat_type string, risk_score double, ref_id string, summary string")
    return rows.select(*DETECTION_COLUMNS)


def email_analysis_rows(risked: DataFrame) -> DataFrame:
    """The stored form of an analysis: guarded enums, features and indicators as JSON."""
    guarded = guard_enums(
        risked.withColumns(
            {"features": F.to_json(F.struct(*[c.alias(n) for n, c in em.feature_columns().items()])), "indicators": F.to_json("indicators")}
        ),
        {"spf": fv.SPF_VALUES, "dkim": fv.DKIM_VALUES, "dmarc": fv.DMARC_VALUES, "verdict": fv.VERDICT_VALUES},
        {"verdict": "benign"},
    )
    return guarded.select(*ANALYSIS_COLUMNS)


def write_email_analyses(risked: DataFrame, folder: str, batch: str) -> bool:
    """Add analyses to the stored ones; a message of a tenant is stored once."""
    return insert_batch(email_analysis_rows(risked), folder, batch, ["tenant_id", "message_id"], ["risk_score"])
