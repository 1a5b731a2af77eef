"""Registered learning, forecast and streaming queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions import scoring as sc
from tidewatch.operators import email as em
from tidewatch.operators import forecast as fc
from tidewatch.operators import learning as ln
from tidewatch.functions import text as tx
from tidewatch.plans import dashboard_queries, email_queries, flow_queries, text_queries
from tidewatch.plans import oracle_sql as osql
from tidewatch.plans.standins import VIEWS, view, with_views
from tidewatch.session import prepare, scratch_path
from tidewatch.streaming import events as ev
from tidewatch.streaming import incidents, jobs

QUERIES = {}
ORACLES = {}


def _register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


def _dec(expr: str, digits: int) -> str:
    return f"round(({expr})::DECIMAL(38,12), {digits})::DOUBLE"


# --- classifier -------------------------------------------------------------------------


def _split(s, sf):
    rows = ln.stratified_split(view(s, sf, "v_scored"), "doc_id", "y")
    return rows.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


_register(
    "c03_stratified_split",
    _split,
    with_views(["v_scored"], "SELECT y, count(*) AS n, round_even(0.2::DOUBLE * count(*), 0)::BIGINT AS n_test FROM v_scored GROUP BY 1"),
)


def _labelled_features(s, sf):
    """All e-mail stand-ins; the label is whether the message's event went wrong."""
    features = em.email_features(email_queries._signals(s, sf))
    labels = view(s, sf, "v_detections").select(F.col("id").alias("msg_id"), (F.col("threat_type") == "error").cast("int").alias("label"))
    return features.join(labels, "msg_id")


def _classified(s, sf):
    rows = _labelled_features(s, sf)
    model = ln.train_classifier(rows, list(fv.EMAIL_FEATURES))
    return ln.score_classifier(rows, model).select("msg_id", "label", F.round("probability", 6).alias("probability"))


_register("c01_c02_classifier", _classified)

# --- forecast ---------------------------------------------------------------------------


def _filled(s, sf):
    return fc.fill_hours(view(s, sf, "v_hourly"), "n")


_HOURS = {
    "span": "SELECT series, min(ts) AS lo, max(ts) AS hi FROM v_hourly GROUP BY 1",
    "spine": "SELECT series, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span",
    "filled": """SELECT s.series, s.ts, (row_number() OVER (PARTITION BY s.series ORDER BY s.ts) - 1)::INT AS idx, coalesce(h.n, 0)::DOUBLE AS value
   FROM spine s LEFT JOIN v_hourly h ON h.series = s.series AND h.ts = s.ts""",
}


def _quantiles(source: str, keys: str) -> str:
    on_week = " AND ".join(f"w.{k} = t.{k}" for k in keys.split(", "))
    on_day = " AND ".join(f"h.{k} = t.{k}" for k in keys.split(", "))
    qs = ", ".join(f"round(quantile_cont(value, {q}), 9) AS q{int(q * 100)}" for q in fc.QUANTILES)
    pick = ", ".join(f"CASE WHEN coalesce(w.n, 0) >= 3 THEN w.q{p} ELSE h.q{p} END AS p{p}" for p in (10, 50, 90))
    return f"""
, slot AS (SELECT *, isodow(ts) AS dw, hour(ts) AS hr FROM {source}),
w AS (SELECT {keys}, dw, hr, count(*) AS n, {qs} FROM slot GROUP BY ALL),
h AS (SELECT {keys}, hr, {qs} FROM slot GROUP BY ALL),
pred AS (SELECT t.*, {pick} FROM targets t LEFT JOIN w ON {on_week} AND w.dw = isodow(t.horizon_ts) AND w.hr = hour(t.horizon_ts)
  LEFT JOIN h ON {on_day} AND h.hr = hour(t.horizon_ts))"""


_register(
    "s05_hourly_mean",
    lambda s, sf: fc.hourly_mean(view(s, sf, "v_flow").select("dst_port", "ts", F.col("raw_value").alias("value")), ("dst_port",)).withColumn(
        "value", sc.stable_round(F.col("value"), 6)),
    with_views(["v_flow"], f"SELECT dst_port, date_trunc('hour', ts) AS ts, {_dec('avg(raw_value)', 6)} AS value FROM v_flow GROUP BY ALL"),
)
_register(
    "j05_fill_hours",
    _filled,
    with_views(["v_hourly"], "SELECT series, ts, idx, value FROM filled", _HOURS),
)
_register(
    "q01_history_gate",
    lambda s, sf: fc.history_gate(view(s, sf, "v_hourly"), 700),
    with_views(["v_hourly"], f"""
SELECT series, count(*) AS hours, CASE WHEN count(*) < 700 THEN 'insufficient_history' ELSE 'ok' END AS status, {_dec('count(*)::DOUBLE / 24', 1)} AS have_days,
 700::DOUBLE / 24 AS need_days FROM v_hourly GROUP BY 1"""),
)
_register(
    "f28_calendar",
    lambda s, sf: view(s, sf, "v_detections").select("id", *[(sc.stable_round(c, 6) + 0.0).alias(n) for n, c in fc.calendar(F.col("ts")).items()]),
    with_views(["v_detections"], "SELECT id, " + ", ".join(
        f"{_dec(f'{fn}(2 * pi() * {part} / {n})', 6)} + 0.0::DOUBLE AS {name}"
        for name, fn, part, n in (("hour_sin", "sin", "hour(ts)", 24), ("hour_cos", "cos", "hour(ts)", 24), ("day_sin", "sin", "(isodow(ts) - 1)", 7), ("day_cos", "cos", "(isodow(ts) - 1)", 7))
    ) + " FROM v_detections"),
)
_register(
    "f29_pinball_loss",
    lambda s, sf: view(s, sf, "v_forecasts").groupBy("tenant_id", "series").agg(
        *[sc.stable_round(F.avg(fc.pinball_loss(F.col("p50"), F.col(p), q)), 6).alias(f"loss_{p}") for p, q in (("p10", 0.1), ("p90", 0.9))]),
    with_views(["v_forecasts"], "SELECT tenant_id, series, " + ", ".join(
        f"{_dec(f'avg(greatest({q}::DOUBLE * (p50 - {p}), ({q}::DOUBLE - 1) * (p50 - {p})))', 6)} AS loss_{p}" for p, q in (("p10", 0.1), ("p90", 0.9))
    ) + " FROM v_forecasts GROUP BY 1, 2"),
)
_ROUNDED = {p: sc.stable_round for p in ("p10", "p50", "p90")}
_register(
    "q02_quantile_forecast",
    lambda s, sf: fc.quantile_forecast(_filled(s, sf)).withColumns({p: f(F.col(p), 6) for p, f in _ROUNDED.items()}),
    with_views(["v_hourly"], """
, targets AS (SELECT series, hi AS issued_at, unnest(generate_series(hi + INTERVAL 1 HOUR, hi + INTERVAL 48 HOURS, INTERVAL 1 HOUR)) AS horizon_ts FROM span)"""
               + _quantiles("filled", "series") + f"""
SELECT series, issued_at, horizon_ts, {_dec('p10', 6)} AS p10, {_dec('p50', 6)} AS p50, {_dec('p90', 6)} AS p90 FROM pred""", _HOURS),
)
_ORIGINS = """
, sizes AS (SELECT series, count(*) AS n FROM filled GROUP BY 1),
starts AS (SELECT series, unnest(range(n - 168, n - 24, 12))::INT AS origin FROM sizes WHERE n - 168 >= 336)"""
_register(
    "w06_encoder_windows",
    lambda s, sf: fc.windows_around(_filled(s, sf), fc.origins(_filled(s, sf), test_days=7)).select("series", "origin", "ts", "value", "offset"),
    with_views(["v_hourly"], _ORIGINS + """
SELECT f.series, origin, ts, value, idx - origin AS "offset" FROM filled f JOIN starts s ON s.series = f.series AND idx - origin BETWEEN -168 AND 23""", _HOURS),
)
_register(
    "q03_a24_rolling_backtest",
    lambda s, sf: fc.rolling_backtest(_filled(s, sf), test_days=7),
    with_views(["v_hourly"], _ORIGINS + """,
train AS (SELECT f.series, origin, ts, value FROM filled f JOIN starts s ON s.series = f.series AND idx < origin),
targets AS (SELECT f.series, origin, ts AS horizon_ts, value AS actual FROM filled f JOIN starts s ON s.series = f.series AND idx - origin BETWEEN 0 AND 23)"""
               + _quantiles("train", "series, origin") + f"""
SELECT series, count(DISTINCT origin) AS windows, count(*) AS forecast_hours, {_dec('avg(abs(p50 - actual))', 6)} AS mae, {_dec('sqrt(avg((p50 - actual) * (p50 - actual)))', 6)} AS rmse,
 {_dec('avg((actual BETWEEN p10 AND p90)::INT)', 6)} AS coverage, {_dec('avg(greatest(0.5 * (actual - p50), -0.5 * (actual - p50)))', 6)} AS pinball_p50,
 {_dec('avg(abs(p50 - actual)) / CASE WHEN avg(actual) = 0 THEN 1e-9 ELSE avg(actual) END', 6)} AS mae_over_mean FROM pred GROUP BY 1""", _HOURS),
)

# --- streams ----------------------------------------------------------------------------

_NOW = {"availableNow": True}


def _table_stream(s, sf, name):
    """One of the given tables as a stream, whether it is one file or a folder of files.

    The source takes a file only by a pattern; the pattern has this one match.
    """
    prepare(s)
    path = f"{sf}/{name}.parquet"
    return s.readStream.schema(s.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _stream(s, sf, name):
    """A stand-in view over its table read as a stream."""
    return s.sql(VIEWS[name], events=_table_stream(s, sf, "events"))


def _finish(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _live_rollup(s, sf):
    path, checkpoint = scratch_path(s, "rollup"), scratch_path(s, "rollup-state")
    _finish(jobs.start_rollup(_stream(s, sf, "v_detections"), path, checkpoint, _NOW))
    return jobs.read_rollup(s, path).withColumn("avg_risk", sc.stable_round(F.col("avg_risk"), 6))


_register("x01_rollup_stream", _live_rollup, dashboard_queries.ORACLES["a12_hourly_rollup"])


def _refreshed(s, sf):
    path = scratch_path(s, "rollup-full")
    jobs.refresh_rollup(view(s, sf, "v_detections"), path)
    return s.read.parquet(path).drop("date").withColumn("avg_risk", sc.stable_round(F.col("avg_risk"), 6))


_register("x02_rollup_refresh", _refreshed, dashboard_queries.ORACLES["a12_hourly_rollup"])


def _events(s, sf):
    path, checkpoint = scratch_path(s, "events"), scratch_path(s, "events-state")

    def deliver(batch, batch_id):
        batch.write.mode("overwrite").text(f"{path}/batch_id={batch_id}")

    _finish(jobs.fan_out(jobs.event_stream(_stream(s, sf, "v_detections"), 2), deliver, checkpoint, _NOW))
    return ev.parse_payload(s.read.text(path).select("value"))


_register(
    "x03_x04_event_stream",
    _events,
    with_views(["v_detections"], """
SELECT 'detection' AS event, id, tenant_id, module, threat_type, risk_score, ref_id, left(coalesce(summary,''),200) AS summary, ts FROM v_detections WHERE tenant_id = 2"""),
)


def _incident_history(s, sf):
    v = view(s, sf, "v_detections").join(view(s, sf, "v_flow").select(F.col("flow_id").alias("id"), "raw_value"), "id")
    return v.select(
        F.col("tenant_id").alias("id"), F.col("id").alias("change_id"), "ts",
        F.when(F.col("raw_value") > 100, "high").otherwise("low").alias("severity"), F.when(F.col("module") == "network", "open").otherwise("resolved").alias("status"))


_register(
    "x03_incident_changes",
    lambda s, sf: jobs.incident_changes(_incident_history(s, sf)),
    with_views(["v_detections", "v_flow"], """
, h AS (SELECT d.tenant_id AS id, d.id AS change_id, d.ts, CASE WHEN f.raw_value > 100 THEN 'high' ELSE 'low' END AS severity,
   CASE WHEN d.module = 'network' THEN 'open' ELSE 'resolved' END AS status FROM v_detections d JOIN v_flow f ON f.flow_id = d.id),
l AS (SELECT *, lag(severity) OVER w AS ps, lag(status) OVER w AS pt FROM h WINDOW w AS (PARTITION BY id ORDER BY ts, change_id))
SELECT id, change_id, ts, severity, status FROM l WHERE ps IS NULL OR ps <> severity OR pt <> status"""),
)


def _live_incidents(s, sf):
    """Incident events as payloads, of all changes that the watermark has passed."""
    path, checkpoint = scratch_path(s, "incidents"), scratch_path(s, "incidents-state")
    changes = _stream(s, sf, "v_detections").select(
        (F.col("id") % 500).alias("id"), "ts", F.col("id").alias("change_id"), "tenant_id", F.lit("port_scan").alias("kind"),
        F.when(F.col("risk_score") > 0.5, "high").otherwise("low").alias("severity"), F.col("model_version").alias("entity_count"),
        F.when(F.col("module") == "network", "open").otherwise("resolved").alias("status"))
    _finish(incidents.start_incident_events(changes, path, checkpoint, "1 hour", trigger=_NOW))
    found = s.read.parquet(path).select(F.col("payload").alias("value"), F.timestamp_micros("at").alias("ts"), "change_id")
    parsed = F.from_json("value", ev.INCIDENT_SCHEMA)
    return found.select(parsed.alias("e"), "ts", "change_id").select("e.*", "ts", "change_id")


_register(
    "x03_incident_stream",
    _live_incidents,
    with_views(["v_detections"], """
, h AS (SELECT id % 500 AS id, id AS change_id, ts, tenant_id, model_version, CASE WHEN risk_score > 0.5 THEN 'high' ELSE 'low' END AS severity,
   CASE WHEN module = 'network' THEN 'open' ELSE 'resolved' END AS status FROM v_detections),
l AS (SELECT *, lag(severity) OVER w AS ps, lag(status) OVER w AS pt FROM h WINDOW w AS (PARTITION BY id ORDER BY ts, change_id))
SELECT 'incident' AS event, id, tenant_id, 'port_scan' AS kind, severity, model_version::BIGINT AS entity_count, status, ts, change_id FROM l
WHERE (ps IS NULL OR ps <> severity OR pt <> status) AND ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM h)"""),
)


def _live_triage(s, sf):
    path, checkpoint = scratch_path(s, "triage"), scratch_path(s, "triage-state")
    _finish(jobs.start_triage(_stream(s, sf, "v_log").drop("batch_key"), path, checkpoint, trigger=_NOW))
    return jobs.read_triage(s, path).withColumn("batch_key", F.to_date("batch_key"))


_register("x06_triage_stream", _live_triage, flow_queries.ORACLES["n02_f31_flow_triage"])


def _live_scores(s, sf):
    """Messages from a stream of documents, scored as they come."""
    docs = _table_stream(s, sf, "documents")
    messages = email_queries.raw_messages(docs.repartition(s.sparkContext.defaultParallelism))
    path, checkpoint = scratch_path(s, "scores"), scratch_path(s, "scores-state")
    scored = em.score_messages(messages).select("msg_id", "from_domain", "verdict", "risk_score", F.size("indicators").alias("n"))
    _finish(jobs.write_batches(scored, path, checkpoint, trigger=_NOW))
    return s.read.parquet(path).drop("batch_id")


def _batch_scores(s, sf):
    return em.score_messages(email_queries._raw_messages(s, sf)).select("msg_id", "from_domain", "verdict", "risk_score", F.size("indicators").alias("n"))


_BODY = f"lower('report ' || doc_id || ' ' || regexp_replace(text, '{tx.SPACE}+', ' ', 'g'))"
_HITS = {c: osql.hits("body", p) for c, p in fv.PRESSURE_PHRASES.items()}
_SCORED = (
    with_views([], "", {"docs": "SELECT doc_id, text AS html FROM documents"}).rstrip()
    + text_queries.findings_sql("docs", "doc_id", "found")
    + f"""
, per AS (SELECT doc_id, count(*) AS urls, sum(anchor_mismatch::INT) AS am, sum((is_punycode OR homograph_of IS NOT NULL)::INT) AS ho, sum((lookalike_brand IS NOT NULL)::INT) AS lo,
   sum(is_ip_literal::INT) AS ip, sum(has_credentials::INT) AS cr, sum(is_shortener::INT) AS sh, sum((subdomain_depth >= 4)::INT) AS de FROM found GROUP BY 1),
bodies AS (SELECT doc_id, {_BODY} AS body FROM documents),
cats AS (SELECT doc_id, {' + '.join(f'({h} > 0)::INT' for h in _HITS.values())} AS cats_n, {_HITS['credential_bait']} > 0 AS bait FROM bodies),
j AS (SELECT cats.*, coalesce(urls, 0) AS urls, coalesce(am, 0) AS am, coalesce(ho, 0) AS ho, coalesce(lo, 0) AS lo, coalesce(ip, 0) AS ip, coalesce(cr, 0) AS cr, coalesce(sh, 0) AS sh,
   coalesce(de, 0) AS de FROM cats LEFT JOIN per ON per.doc_id = cats.doc_id),
risked AS (SELECT doc_id, (2 + am + ho + lo + ip + cr + sh + de + (cats_n >= 2)::INT + (bait AND urls > 0)::INT)::INT AS n,
   {_dec('least(0.99::DOUBLE, 1 - 0.75::DOUBLE * 0.98::DOUBLE * pow(0.75::DOUBLE, am + cr) * pow(0.65::DOUBLE, ho) * pow(0.72::DOUBLE, lo) * pow(0.78::DOUBLE, ip) * pow(0.88::DOUBLE, sh) * pow(0.9::DOUBLE, de) * (1 - CASE WHEN cats_n >= 2 THEN least(0.2::DOUBLE, 0.06::DOUBLE * cats_n) ELSE 0 END) * (CASE WHEN bait AND urls > 0 THEN 0.75::DOUBLE ELSE 1 END))', 4)} AS risk_score FROM j)
SELECT doc_id AS msg_id, 'example.org' AS from_domain, risk_score, n,
 CASE WHEN risk_score >= 0.85 THEN 'phishing' WHEN risk_score >= 0.55 THEN 'suspicious' WHEN risk_score >= 0.25 THEN 'low_confidence' ELSE 'benign' END AS verdict FROM risked"""
)
_register("x05_scoring_stream", _live_scores, _SCORED)
_register("e05_score_messages", _batch_scores, _SCORED)

