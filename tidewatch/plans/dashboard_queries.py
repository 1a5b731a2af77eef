"""Registered dashboard queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import domains, fixed_values as fv, scoring as sc
from tidewatch.operators import dashboards as d, quality as q
from tidewatch.plans.standins import AS_OF, view, with_views
from tidewatch.plans import oracle_sql as osql

QUERIES = {}
ORACLES = {}


def _email(spark, sf):
    v = view(spark, sf, "v_email")
    return v.select(
        "*",
        domains.registrable_domain(F.col("from_host")).alias("from_domain"),
        sc.email_verdict(F.col("risk_score")).alias("verdict"),
    )


EMAIL_CTE = {
    "email": f"""SELECT *, CASE WHEN from_host IS NOT NULL THEN {osql.registrable('from_host')} END AS from_domain,
        CASE WHEN risk_score >= 0.85 THEN 'phishing' WHEN risk_score >= 0.55 THEN 'suspicious'
             WHEN risk_score >= 0.25 THEN 'low_confidence' ELSE 'benign' END AS verdict FROM v_email"""
}
TS = f"TIMESTAMP '{AS_OF}'"


def _register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


_register(
    "a01_summary",
    lambda s, sf: d.summary(view(s, sf, "v_detections"), 1, AS_OF, 240),
    with_views(["v_detections"], f"""
SELECT count(*) AS total_detections,
  count(*) FILTER (WHERE module='email') AS email_detections,
  count(*) FILTER (WHERE module='news') AS news_detections,
  count(*) FILTER (WHERE module='network') AS network_detections,
  count(*) FILTER (WHERE risk_score >= 0.85) AS critical_count,
  count(*) FILTER (WHERE risk_score >= 0.55 AND risk_score < 0.85) AS suspicious_count,
  coalesce(round((avg(risk_score))::DECIMAL(38,12), 4)::DOUBLE,0.0::DOUBLE) AS avg_risk, max(ts) AS last_detection_at
FROM v_detections WHERE tenant_id = 1 AND ts >= {TS} - INTERVAL 240 HOURS"""),
)
_register(
    "a02_summary_delta",
    lambda s, sf: d.summary_delta(view(s, sf, "v_detections"), 1, AS_OF, 240),
    with_views(["v_detections"], f"""
, c AS (SELECT count(*) AS n FROM v_detections WHERE tenant_id=1 AND ts >= {TS} - INTERVAL 240 HOURS),
p AS (SELECT count(*) AS n FROM v_detections WHERE tenant_id=1 AND ts >= {TS} - INTERVAL 480 HOURS AND ts < {TS} - INTERVAL 240 HOURS)
SELECT c.n AS current_count, p.n AS previous_count,
  CASE WHEN p.n = 0 THEN NULL ELSE round(((c.n - p.n)::DOUBLE / p.n * 100)::DECIMAL(38,12), 1)::DOUBLE END AS pct_change FROM c CROSS JOIN p"""),
)
_register(
    "a03_threat_volume",
    lambda s, sf: d.threat_volume(view(s, sf, "v_detections"), 1, AS_OF, 30),
    with_views(["v_detections"], f"""
, b AS (SELECT unnest(generate_series({TS} - INTERVAL 30 DAYS, {TS}, INTERVAL 1 HOUR)) AS bucket),
o AS (SELECT date_trunc('hour', ts) AS bucket, module, count(*) AS n, avg(risk_score) AS r, sum(risk_score) AS sr
      FROM v_detections WHERE tenant_id = 1 AND ts >= {TS} - INTERVAL 30 DAYS GROUP BY 1, 2)
SELECT b.bucket, coalesce(sum(o.n),0)::BIGINT AS total,
  coalesce(sum(o.n) FILTER (WHERE module='email'),0)::BIGINT AS email,
  coalesce(sum(o.n) FILTER (WHERE module='news'),0)::BIGINT AS news,
  coalesce(sum(o.n) FILTER (WHERE module='network'),0)::BIGINT AS network,
  coalesce(round((avg(o.r))::DECIMAL(38,12), 4)::DOUBLE,0.0::DOUBLE) AS avg_risk,
  coalesce(round((sum(o.sr)/sum(o.n))::DECIMAL(38,12), 4)::DOUBLE,0.0::DOUBLE) AS weighted_risk
FROM b LEFT JOIN o ON o.bucket = b.bucket GROUP BY b.bucket ORDER BY b.bucket"""),
)
_register(
    "a04_detection_rates",
    lambda s, sf: d.detection_rates(view(s, sf, "v_detections"), 1, AS_OF, 30),
    with_views(["v_detections"], f"""
SELECT module, count(*) AS total, count(*) FILTER (WHERE risk_score >= 0.85) AS critical,
  count(*) FILTER (WHERE risk_score >= 0.55 AND risk_score < 0.85) AS suspicious,
  count(*) FILTER (WHERE risk_score < 0.55) AS benign, round((avg(risk_score))::DECIMAL(38,12), 4)::DOUBLE AS avg_risk
FROM v_detections WHERE tenant_id=1 AND ts >= {TS} - INTERVAL 30 DAYS GROUP BY module"""),
)
_RECENT = """
, m AS (SELECT * FROM v_models WHERE is_active)
SELECT d.id, d.ts, d.module, d.threat_type, d.risk_score, d.ref_id, d.summary, m.name AS model_name, m.version AS model_version
FROM v_detections d LEFT JOIN m ON m.id = d.model_version WHERE d.tenant_id = 1 {extra}
ORDER BY d.ts DESC, d.id LIMIT {n}"""
_register(
    "a05_recent_detections",
    lambda s, sf: d.recent_detections(view(s, sf, "v_detections"), view(s, sf, "v_models"), 1, 100),
    with_views(["v_detections", "v_models"], _RECENT.format(extra="", n=100)),
)
_register(
    "p04_recent_detections_by_module",
    lambda s, sf: d.recent_detections(view(s, sf, "v_detections"), view(s, sf, "v_models"), 1, 100, "network"),
    with_views(["v_detections", "v_models"], _RECENT.format(extra="AND d.module='network'", n=100)),
)
_register(
    "a06_top_threat_domains",
    lambda s, sf: d.top_threat_domains(_email(s, sf), 1, AS_OF, 30, 10),
    with_views(["v_email"], f"""
SELECT from_domain, count(*) AS attempts, round((avg(risk_score))::DECIMAL(38,12), 4)::DOUBLE AS avg_risk, max(analyzed_at) AS last_seen,
  count(*) FILTER (WHERE verdict='phishing') AS phishing_count
FROM email WHERE tenant_id=1 AND from_domain IS NOT NULL AND analyzed_at >= {TS} - INTERVAL 30 DAYS AND risk_score >= 0.55
GROUP BY from_domain ORDER BY attempts DESC, avg_risk DESC, from_domain LIMIT 10""", EMAIL_CTE),
)
_register(
    "a07_auth_failure_breakdown",
    lambda s, sf: d.auth_failure_breakdown(_email(s, sf), 1, AS_OF, 30),
    with_views(["v_email"], f"""
SELECT count(*) AS analyzed, count(*) FILTER (WHERE spf='pass') AS spf_pass,
  count(*) FILTER (WHERE spf IN ('fail','softfail')) AS spf_fail, count(*) FILTER (WHERE dkim='pass') AS dkim_pass,
  count(*) FILTER (WHERE dkim='fail') AS dkim_fail, count(*) FILTER (WHERE dmarc='pass') AS dmarc_pass,
  count(*) FILTER (WHERE dmarc='fail') AS dmarc_fail, count(*) FILTER (WHERE dkim_aligned IS FALSE) AS dkim_misaligned
FROM v_email WHERE tenant_id=1 AND analyzed_at >= {TS} - INTERVAL 30 DAYS"""),
)
_register(
    "a08_open_incidents",
    lambda s, sf: d.open_incidents(view(s, sf, "v_incidents"), view(s, sf, "v_anomalies"), 1),
    with_views(["v_incidents", "v_anomalies"], """
SELECT i.id, i.tenant_id, i.kind, i.severity, i.status, i.opened_at, count(a.id) AS anomaly_count
FROM v_incidents i LEFT JOIN v_anomalies a ON a.incident_id = i.id
WHERE i.tenant_id = 1 AND i.status IN ('open','investigating') GROUP BY ALL"""),
)
_register(
    "a09_forecast_series",
    lambda s, sf: d.forecast_series(view(s, sf, "v_forecasts"), 1, "error").drop("tenant_id", "series"),
    with_views(["v_forecasts"], """
SELECT horizon_ts, p10, p50, p90, issued_at FROM v_forecasts WHERE tenant_id=1 AND series='error'
 AND issued_at = (SELECT max(issued_at) FROM v_forecasts WHERE tenant_id=1 AND series='error')"""),
)
_register(
    "a09_latest_forecasts",
    lambda s, sf: d.latest_forecasts(view(s, sf, "v_forecasts")).withColumn("p50", sc.stable_round(F.col("p50"), 6)),
    with_views(["v_forecasts"], """
SELECT tenant_id, series, issued_at, horizon_ts, p10, round((p50)::DECIMAL(38,12), 6)::DOUBLE AS p50, p90 FROM v_forecasts
QUALIFY issued_at = max(issued_at) OVER (PARTITION BY tenant_id, series)"""),
)
_register(
    "a09_forecast_status",
    lambda s, sf: d.forecast_status(view(s, sf, "v_forecasts"), 1, "error").unionByName(
        d.forecast_status(view(s, sf, "v_forecasts"), 1, "no_such_series")),
    with_views(["v_forecasts"], """
, run AS (SELECT * FROM v_forecasts WHERE tenant_id=1 AND series='error' AND issued_at = (SELECT max(issued_at) FROM v_forecasts WHERE tenant_id=1 AND series='error'))
SELECT 'error' AS series, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'insufficient_history' END AS status, count(*) AS points, max(issued_at) AS issued_at FROM run
UNION ALL SELECT 'no_such_series', 'insufficient_history', 0, NULL"""),
)
_register(
    "a10_model_versions_active",
    # The registry joined with how often each model was used, so the work follows the detections.
    lambda s, sf: d.model_versions_active(view(s, sf, "v_models")).join(
        view(s, sf, "v_detections").groupBy(F.col("model_version").alias("id")).agg(F.count("*").alias("detections")), "id", "left"
    ).withColumn("detections", F.coalesce("detections", F.lit(0))),
    with_views(["v_models", "v_detections"], """
SELECT m.id, m.name, m.version, m.task, count(d.id) AS detections FROM v_models m LEFT JOIN v_detections d ON d.model_version = m.id
WHERE m.is_active GROUP BY ALL"""),
)
_register(
    "a11_feedback_training_set",
    lambda s, sf: d.feedback_training_set(view(s, sf, "v_feedback"), "email", 50),
    with_views(["v_feedback"], """
SELECT id, subject_kind, created_at FROM v_feedback WHERE subject_kind='email' AND used_in_training IS NULL ORDER BY created_at, id LIMIT 50"""),
)
_ROLLUP = """
SELECT date_trunc('hour', ts) AS bucket, tenant_id, module, threat_type, count(*) AS n, round((avg(risk_score))::DECIMAL(38,12), 6)::DOUBLE AS avg_risk, max(risk_score) AS max_risk
FROM v_detections GROUP BY ALL"""
_register(
    "a12_hourly_rollup",
    lambda s, sf: d.hourly_rollup(view(s, sf, "v_detections")).withColumn("avg_risk", sc.stable_round(F.col("avg_risk"), 6)),
    with_views(["v_detections"], _ROLLUP),
)
_register(
    "a13_risk_band_counts",
    lambda s, sf: view(s, sf, "v_detections").groupBy("tenant_id", sc.risk_band(F.col("risk_score")).alias("band")).agg(
        F.count("*").alias("n"), F.count_if(F.col("module") == "network").alias("network")),
    with_views(["v_detections"], """
SELECT tenant_id, CASE WHEN risk_score >= 0.85 THEN 'critical' WHEN risk_score >= 0.55 THEN 'suspicious' ELSE 'benign' END AS band,
  count(*) AS n, count(*) FILTER (WHERE module='network') AS network FROM v_detections GROUP BY ALL"""),
)

_SEV = """CASE WHEN contains(lower(result),'critical') OR contains(lower(result),'high') OR contains(lower(result),'fake') OR contains(lower(result),'misleading')
   OR (contains(result,'%') AND coalesce(TRY_CAST(regexp_extract(result,'^\\s*([+-]?[0-9]+)',1) AS INT) < 50, false)) THEN 'High'
 WHEN contains(lower(result),'medium') OR contains(lower(result),'low') OR contains(lower(result),'suspicious')
   OR (contains(result,'%') AND coalesce(TRY_CAST(regexp_extract(result,'^\\s*([+-]?[0-9]+)',1) AS INT) BETWEEN 50 AND 74, false)) THEN 'Medium' ELSE 'Low' END"""
_register(
    "p11_p12_history_search",
    lambda s, sf: d.search_history(view(s, sf, "v_history"), term='"K": 7', risk="HIGH_RISK"),
    with_views(["v_history"], f"""
SELECT * FROM (SELECT *, {_SEV} AS severity FROM v_history) WHERE severity='High'
 AND (contains(lower(summary),'"k": 7') OR contains(lower(result),'"k": 7') OR contains(lower(type),'"k": 7'))"""),
)
_register(
    "p12_history_severity",
    lambda s, sf: view(s, sf, "v_history").groupBy("type", "result", sc.history_severity(F.col("result")).alias("severity")).agg(F.count("*").alias("n")),
    with_views(["v_history"], f"SELECT type, result, {_SEV} AS severity, count(*) AS n FROM v_history GROUP BY ALL"),
)
_RISK = """CASE WHEN type='NEWS' THEN 100 - coalesce(TRY_CAST(regexp_extract(result,'(\\d+)%',1) AS INT),0)
  ELSE CASE upper(result) WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 25 ELSE 0 END END"""
_register(
    "p13_t05_history_sort",
    lambda s, sf: d.sort_history(view(s, sf, "v_history"), "RISK_HIGH").select("id", "type", "result", "risk"),
    with_views(["v_history"], f"SELECT id, type, result, {_RISK} AS risk FROM v_history ORDER BY risk DESC, id"),
)
_register(
    "a14_history_counters",
    lambda s, sf: d.history_counters(view(s, sf, "v_history")),
    with_views(["v_history"], """
, h AS (SELECT type, lower(result) AS r, TRY_CAST(regexp_extract(result,'^\\s*([+-]?[0-9]+)',1) AS INT) AS p FROM v_history)
SELECT count(*) AS scans,
 count(*) FILTER (WHERE type='NEWS' AND (contains(r,'fake') OR contains(r,'misleading') OR (contains(r,'%') AND p < 50))) AS fake_news,
 count(*) FILTER (WHERE type='CYBER' AND (contains(r,'critical') OR contains(r,'high'))) AS cyber_threats,
 count(*) FILTER (WHERE type='NEWS') AS news_scans, count(*) FILTER (WHERE type='CYBER') AS cyber_scans,
 count(*) FILTER (WHERE type='EMAIL') AS email_scans FROM h"""),
)

_register(
    "p01_p02_tenant_window",
    lambda s, sf: d.trailing_window(d.tenant_scope(view(s, sf, "v_detections"), 3), "ts", d.hours_before(AS_OF, 72)).select("id", "ts", "module", "risk_score"),
    with_views(["v_detections"], f"SELECT id, ts, module, risk_score FROM v_detections WHERE tenant_id=3 AND ts >= {TS} - INTERVAL 72 HOURS"),
)
_register(
    "p03_previous_window",
    lambda s, sf: view(s, sf, "v_detections").filter((F.col("ts") >= d.hours_before(AS_OF, 480)) & (F.col("ts") < d.hours_before(AS_OF, 240))).groupBy("tenant_id").agg(F.count("*").alias("n")),
    with_views(["v_detections"], f"SELECT tenant_id, count(*) AS n FROM v_detections WHERE ts >= {TS} - INTERVAL 480 HOURS AND ts < {TS} - INTERVAL 240 HOURS GROUP BY ALL"),
)
_register(
    "p06_email_verdict",
    lambda s, sf: _email(s, sf).select("id", "from_domain", "verdict"),
    with_views(["v_email"], "SELECT id, from_domain, verdict FROM email", EMAIL_CTE),
)
_ENUMS = {"spf": fv.SPF_VALUES, "dkim": fv.DKIM_VALUES, "dmarc": fv.DMARC_VALUES}
_register(
    "p09_enum_guard",
    lambda s, sf: q.guard_enums(view(s, sf, "v_email"), _ENUMS).select("id", "spf", "dkim", "dmarc"),
    with_views(["v_email"], f"""
SELECT id, CASE WHEN spf IN {fv.SPF_VALUES} THEN spf END AS spf, CASE WHEN dkim IN {fv.DKIM_VALUES} THEN dkim END AS dkim,
  CASE WHEN dmarc IN {fv.DMARC_VALUES} THEN dmarc END AS dmarc FROM v_email"""),
)
_register(
    "p09_enum_violations",
    lambda s, sf: q.enum_violations(view(s, sf, "v_email"), _ENUMS),
    with_views(["v_email"], f"""
SELECT count(*) FILTER (WHERE spf NOT IN {fv.SPF_VALUES}) AS spf_violations, count(*) FILTER (WHERE dkim NOT IN {fv.DKIM_VALUES}) AS dkim_violations,
  count(*) FILTER (WHERE dmarc NOT IN {fv.DMARC_VALUES}) AS dmarc_violations FROM v_email"""),
)
_register(
    "p10_range_check",
    lambda s, sf: q.range_violations(view(s, sf, "v_anomalies").unionByName(
        view(s, sf, "v_detections").select("id", F.col("ref_id").alias("incident_id"), F.col("risk_score").alias("score"))), ["score"]),
    with_views(["v_anomalies", "v_detections"], """
SELECT count(*) FILTER (WHERE NOT score BETWEEN 0 AND 1) AS score_out_of_range FROM (SELECT score FROM v_anomalies UNION ALL SELECT risk_score FROM v_detections)"""),
)
_register(
    "p10_one_active_model",
    # Every (name) used by a detection is put up as active twice where tenants disagree on the version.
    lambda s, sf: q.duplicate_active_models(view(s, sf, "v_detections").select(
        F.col("module").alias("name"), (F.col("risk_score") > 0.5).alias("is_active"))),
    with_views(["v_detections"], """
SELECT module AS name, count(*) FILTER (WHERE risk_score > 0.5) AS n_active FROM v_detections GROUP BY ALL HAVING n_active > 1"""),
)
_register(
    "j01_detections_with_model",
    lambda s, sf: d.with_model(view(s, sf, "v_detections"), view(s, sf, "v_models")).groupBy("model_name", "model_version", "module").agg(F.count("*").alias("n")),
    with_views(["v_detections", "v_models"], """
, m AS (SELECT * FROM v_models WHERE is_active)
SELECT m.name AS model_name, m.version AS model_version, d.module, count(*) AS n FROM v_detections d LEFT JOIN m ON m.id = d.model_version GROUP BY ALL"""),
)
_register(
    "j03_incident_children",
    lambda s, sf: view(s, sf, "v_incidents").join(
        view(s, sf, "v_anomalies").filter("incident_id IS NOT NULL").groupBy(F.col("incident_id").alias("id")).agg(F.count("*").alias("children"), F.max("score").alias("max_score")), "id", "left"
    ).select("id", "severity", F.coalesce("children", F.lit(0)).alias("children"), "max_score"),
    with_views(["v_incidents", "v_anomalies"], """
SELECT i.id, i.severity, count(a.id) AS children, max(a.score) AS max_score FROM v_incidents i LEFT JOIN v_anomalies a ON a.incident_id = i.id GROUP BY ALL"""),
)
_register(
    "s08_insert_if_absent",
    # Existing rows: the dated forecasts of tenant 0; new rows: all of them, keyed by (series, horizon).
    lambda s, sf: q.insert_if_absent(
        d.tenant_scope(view(s, sf, "v_forecasts"), 0), view(s, sf, "v_forecasts").withColumn("p50", sc.stable_round(F.col("p50"), 6)),
        ["series", "horizon_ts"], "tenant_id"),
    with_views(["v_forecasts"], """
SELECT tenant_id, series, issued_at, horizon_ts, p10, round((p50)::DECIMAL(38,12), 6)::DOUBLE AS p50, p90 FROM v_forecasts f
WHERE NOT EXISTS (SELECT 1 FROM v_forecasts e WHERE e.tenant_id = 0 AND e.series = f.series AND e.horizon_ts = f.horizon_ts)
QUALIFY row_number() OVER (PARTITION BY series, horizon_ts ORDER BY tenant_id) = 1"""),
)
