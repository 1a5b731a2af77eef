"""Dashboard aggregates over the unified detections table and its side tables.

Every function takes the tables it reads plus an explicit ``as_of``; nothing
depends on the wall clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import scoring as sc
from tidewatch.session import broadcast_if_small, cut_lineage

MODULES = ("email", "news", "network")


def _ts(as_of: datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def hours_before(as_of: datetime | str, hours: int) -> Column:
    return _ts(as_of) - F.make_interval(hours=F.lit(hours))


def days_before(as_of: datetime | str, days: int) -> Column:
    return _ts(as_of) - F.make_interval(days=F.lit(days))


def tenant_scope(df: DataFrame, tenant_id) -> DataFrame:
    """Rows of one tenant; an unset tenant sees nothing."""
    if tenant_id is None:
        return df.filter(F.lit(False))
    return df.filter(F.col("tenant_id") == F.lit(tenant_id))


def trailing_window(df: DataFrame, column: str, start: Column) -> DataFrame:
    return df.filter(F.col(column) >= start)


def optional_filter(df: DataFrame, column: str, value) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == F.lit(value))


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _bands() -> list[Column]:
    risk = F.col("risk_score")
    return [
        _count_if(risk >= sc.CRITICAL).alias("critical"),
        _count_if((risk >= sc.SUSPICIOUS) & (risk < sc.CRITICAL)).alias("suspicious"),
    ]


def summary(detections: DataFrame, tenant_id, as_of, hours: int) -> DataFrame:
    scoped = trailing_window(tenant_scope(detections, tenant_id), "ts", hours_before(as_of, hours))
    critical, suspicious = _bands()
    return scoped.agg(
        F.count("*").alias("total_detections"),
        *[_count_if(F.col("module") == m).alias(f"{m}_detections") for m in MODULES],
        critical.alias("critical_count"),
        suspicious.alias("suspicious_count"),
        F.coalesce(sc.stable_round(F.avg("risk_score"), 4), F.lit(0.0)).alias("avg_risk"),
        F.max("ts").alias("last_detection_at"),
    )


def summary_delta(detections: DataFrame, tenant_id, as_of, hours: int) -> DataFrame:
    """Both windows in one pass over ``[as_of - 2n, ...)``."""
    start, previous = hours_before(as_of, hours), hours_before(as_of, 2 * hours)
    scoped = trailing_window(tenant_scope(detections, tenant_id), "ts", previous)
    counts = scoped.agg(
        _count_if(F.col("ts") >= start).alias("current_count"),
        _count_if(F.col("ts") < start).alias("previous_count"),
    )
    change = (F.col("current_count") - F.col("previous_count")) / F.col("previous_count") * 100
    return counts.withColumn("pct_change", F.when(F.col("previous_count") != 0, sc.stable_round(change, 1)))


def hour_spine(spark, start: Column, end: Column) -> DataFrame:
    """One row per hour, both ends included."""
    return spark.range(1).select(
        F.explode(F.sequence(F.date_trunc("hour", start), F.date_trunc("hour", end), F.expr("INTERVAL 1 HOUR"))).alias("bucket")
    )


def threat_volume(detections: DataFrame, tenant_id, as_of, days: int) -> DataFrame:
    """Hourly counts on a gap-free axis.

    ``avg_risk`` is the unweighted mean of the module means; the weighted mean
    is carried next to it as ``weighted_risk``.
    """
    end = F.date_trunc("hour", _ts(as_of))
    start = end - F.make_interval(days=F.lit(days))
    observed = (
        trailing_window(tenant_scope(detections, tenant_id), "ts", start)
        .groupBy(F.date_trunc("hour", "ts").alias("bucket"), "module")
        .agg(F.count("*").alias("n"), F.avg("risk_score").alias("mean_risk"), F.sum("risk_score").alias("sum_risk"))
        .groupBy("bucket")
        .agg(
            F.sum("n").alias("total"),
            *[F.sum(F.when(F.col("module") == m, F.col("n"))).alias(m) for m in MODULES],
            F.avg("mean_risk").alias("avg_risk"),
            (F.sum("sum_risk") / F.sum("n")).alias("weighted_risk"),
        )
    )
    # Both sides hold at most 24 * days + 1 rows inside the spine.
    spine = hour_spine(detections.sparkSession, start, end)
    counts = ["total", *MODULES]
    return (
        spine.join(observed, "bucket", "left")
        .select(
            "bucket",
            *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
            *[F.coalesce(sc.stable_round(F.col(c), 4), F.lit(0.0)).alias(c) for c in ("avg_risk", "weighted_risk")],
        )
        .orderBy("bucket")
    )


def detection_rates(detections: DataFrame, tenant_id, as_of, days: int) -> DataFrame:
    scoped = trailing_window(tenant_scope(detections, tenant_id), "ts", days_before(as_of, days))
    return (
        scoped.groupBy("module")
        .agg(
            F.count("*").alias("total"),
            *_bands(),
            _count_if(F.col("risk_score") < sc.SUSPICIOUS).alias("benign"),
            sc.stable_round(F.avg("risk_score"), 4).alias("avg_risk"),
        )
        .orderBy(F.desc("total"), "module")
    )


def active_models(models: DataFrame) -> DataFrame:
    """The active registry row per id, so that a join never multiplies rows."""
    return models.filter("is_active").groupBy("id").agg(F.min_by(F.struct("name", "version"), "name").alias("m")).select(
        F.col("id").alias("model_id"), F.col("m.name").alias("model_name"), F.col("m.version").alias("registry_version")
    )


def with_model(detections: DataFrame, models: DataFrame) -> DataFrame:
    """Detections left-joined to the model that scored them."""
    registry = broadcast_if_small(active_models(models))
    joined = detections.join(registry, F.col("model_version") == F.col("model_id"), "left")
    return joined.drop("model_id", "model_version").withColumnRenamed("registry_version", "model_version")


def recent_detections(detections: DataFrame, models: DataFrame, tenant_id, limit: int, module: str | None = None) -> DataFrame:
    """Top-n first, then the join on the n rows that are left."""
    scoped = optional_filter(tenant_scope(detections, tenant_id), "module", module)
    newest = scoped.orderBy(F.desc("ts"), "id").limit(limit)
    return (
        with_model(newest, models)
        .select("id", "ts", "module", "threat_type", "risk_score", "ref_id", "summary", "model_name", "model_version")
        .orderBy(F.desc("ts"), "id")
    )


def top_threat_domains(analyses: DataFrame, tenant_id, as_of, days: int, limit: int) -> DataFrame:
    scoped = trailing_window(tenant_scope(analyses, tenant_id), "analyzed_at", days_before(as_of, days)).filter(
        F.col("from_domain").isNotNull() & (F.col("risk_score") >= sc.SUSPICIOUS)
    )
    return (
        scoped.groupBy("from_domain")
        .agg(
            F.count("*").alias("attempts"),
            sc.stable_round(F.avg("risk_score"), 4).alias("avg_risk"),
            F.max("analyzed_at").alias("last_seen"),
            _count_if(F.col("verdict") == "phishing").alias("phishing_count"),
        )
        .orderBy(F.desc("attempts"), F.desc("avg_risk"), "from_domain")
        .limit(limit)
    )


def auth_failure_breakdown(analyses: DataFrame, tenant_id, as_of, days: int) -> DataFrame:
    scoped = trailing_window(tenant_scope(analyses, tenant_id), "analyzed_at", days_before(as_of, days))
    spf, dkim, dmarc = F.col("spf"), F.col("dkim"), F.col("dmarc")
    return scoped.agg(
        F.count("*").alias("analyzed"),
        _count_if(spf == "pass").alias("spf_pass"),
        _count_if(spf.isin("fail", "softfail")).alias("spf_fail"),
        _count_if(dkim == "pass").alias("dkim_pass"),
        _count_if(dkim == "fail").alias("dkim_fail"),
        _count_if(dmarc == "pass").alias("dmarc_pass"),
        _count_if(dmarc == "fail").alias("dmarc_fail"),
        F.count_if(F.col("dkim_aligned").eqNullSafe(False)).alias("dkim_misaligned"),
    )


def open_incidents(incidents: DataFrame, anomalies: DataFrame, tenant_id) -> DataFrame:
    """Children are counted before the join, so the shuffle carries one row per incident."""
    children = anomalies.filter("incident_id IS NOT NULL").groupBy("incident_id").agg(F.count("id").alias("n_children"))
    still_open = tenant_scope(incidents, tenant_id).filter(F.col("status").isin("open", "investigating"))
    return (
        still_open.join(children, still_open["id"] == children["incident_id"], "left")
        .withColumn("anomaly_count", F.coalesce("n_children", F.lit(0)))
        .drop("incident_id", "n_children")
        .orderBy(sc.severity_rank(F.col("severity")), F.desc("opened_at"), "id")
    )


def forecast_series(forecasts: DataFrame, tenant_id, series: str) -> DataFrame:
    """Only the latest run of a series; the one-row maximum comes from a plain aggregate."""
    scoped = tenant_scope(forecasts, tenant_id).filter(F.col("series") == series)
    latest = scoped.agg(F.max("issued_at").alias("issued_at"))
    return scoped.join(F.broadcast(latest), "issued_at").orderBy("horizon_ts")


def latest_forecasts(forecasts: DataFrame) -> DataFrame:
    """The latest run of every (tenant, series)."""
    keys = ["tenant_id", "series"]
    latest = cut_lineage(forecasts.groupBy(*keys).agg(F.max("issued_at").alias("issued_at")))
    return forecasts.join(broadcast_if_small(latest), [*keys, "issued_at"])


def forecast_status(forecasts: DataFrame, tenant_id, series: str) -> DataFrame:
    """One row: ``ok`` with the run's size, or ``insufficient_history``."""
    run = forecast_series(forecasts, tenant_id, series)
    return run.agg(F.count("*").alias("points"), F.max("issued_at").alias("issued_at")).select(
        F.lit(series).alias("series"),
        F.when(F.col("points") > 0, "ok").otherwise("insufficient_history").alias("status"),
        "points",
        "issued_at",
    )


def model_versions_active(models: DataFrame) -> DataFrame:
    return models.filter("is_active").drop("is_active").orderBy("task", "name")


def feedback_training_set(feedback: DataFrame, subject_kind: str, limit: int, tenant_id=None) -> DataFrame:
    scoped = feedback if tenant_id is None else tenant_scope(feedback, tenant_id)
    return (
        scoped.filter((F.col("subject_kind") == subject_kind) & F.col("used_in_training").isNull())
        .drop("used_in_training")
        .orderBy("created_at", "id")
        .limit(limit)
    )


def hourly_rollup(detections: DataFrame) -> DataFrame:
    return detections.groupBy(F.date_trunc("hour", "ts").alias("bucket"), "tenant_id", "module", "threat_type").agg(
        F.count("*").alias("n"), F.avg("risk_score").alias("avg_risk"), F.max("risk_score").alias("max_risk")
    )


# --- scan history (client side of the dashboard) ------------------------------


def search_history(history: DataFrame, term: str = "", kind: str | None = None, risk: str | None = None) -> DataFrame:
    """Type filter, risk filter (``HIGH_RISK`` or ``SAFE``) and substring search on three fields."""
    out = optional_filter(history, "type", kind).withColumn("severity", sc.history_severity(F.col("result")))
    wanted = {"HIGH_RISK": "High", "SAFE": "Low"}.get(risk or "")
    if wanted:
        out = out.filter(F.col("severity") == wanted)
    needle = F.lower(F.lit(term))
    fields = [F.lower(F.col(c)).contains(needle) for c in ("summary", "result", "type")]
    return out.filter(fields[0] | fields[1] | fields[2])


def sort_history(history: DataFrame, order: str = "NEWEST", kind: str | None = None) -> DataFrame:
    out = optional_filter(history, "type", kind).withColumn("risk", sc.history_risk(F.col("type"), F.col("result")))
    keys = {
        "NEWEST": F.desc("scanned_at"),
        "OLDEST": F.asc("scanned_at"),
        "RISK_HIGH": F.desc("risk"),
        "RISK_LOW": F.asc("risk"),
    }
    return out.orderBy(keys[order], "id")


def history_counters(history: DataFrame) -> DataFrame:
    low = F.lower(F.col("result"))
    percent = F.when(low.contains("%"), F.regexp_extract(low, r"^\s*([+-]?[0-9]+)", 1).try_cast("int"))
    fake = low.contains("fake") | low.contains("misleading") | F.coalesce(percent < 50, F.lit(False))
    severe = low.contains("critical") | low.contains("high")
    return history.agg(
        F.count("*").alias("scans"),
        F.count_if((F.col("type") == "NEWS") & fake).alias("fake_news"),
        F.count_if((F.col("type") == "CYBER") & severe).alias("cyber_threats"),
        *[F.count_if(F.col("type") == t).alias(f"{t.lower()}_scans") for t in ("NEWS", "CYBER", "EMAIL")],
    )
