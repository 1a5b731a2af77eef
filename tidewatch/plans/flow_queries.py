"""Registered flow queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions import scoring as sc
from tidewatch.operators import baseline as bl
from tidewatch.operators import clustering as cl
from tidewatch.operators import flows as fl
from tidewatch.plans import oracle_sql as osql
from tidewatch.plans.standins import table, view, with_views
from tidewatch.session import scratch_path
from tidewatch.sources import flows as flow_files
from tidewatch.sources import sinks

QUERIES = {}
ORACLES = {}


def _register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


def _dec(expr: str, digits: int) -> str:
    return f"round(({expr})::DECIMAL(38,12), {digits})::DOUBLE"


def _flows(s, sf, spread=False):
    """The flow stand-in with its list columns."""
    v = view(s, sf, "v_flow", spread)
    return v.select(
        "*",
        F.array(F.col("fwd_packets"), F.col("fwd_bytes"), F.lit(60).cast("long")).alias("fwd_pkt_lengths"),
        F.when(F.col("bwd_packets") > 0, F.array(F.col("bwd_packets"), F.col("bwd_bytes"))).alias("bwd_pkt_lengths"),
        F.array(F.col("duration_ms"), F.col("raw_value") * 3, F.lit(1.5)).alias("inter_arrival_times"),
        F.create_map(
            F.lit("SYN"), F.col("fwd_packets").cast("int"), F.lit("ack"), F.col("bwd_packets").cast("int"), F.lit("Rst"), F.lit(1)
        ).alias("tcp_flags"),
    )


def _features(s, sf, spread=False):
    return fl.flow_features(_flows(s, sf, spread))


_LISTS = {
    "lists": """SELECT *, [fwd_packets, fwd_bytes, 60]::DOUBLE[] AS fl, CASE WHEN bwd_packets > 0 THEN [bwd_packets, bwd_bytes]::DOUBLE[] ELSE []::DOUBLE[] END AS bl,
   [duration_ms, raw_value * 3, 1.5]::DOUBLE[] AS il, greatest(duration_ms / 1000, 0.000001::DOUBLE) AS secs FROM v_flow"""
}


def _stats_sql(col: str, prefix: str) -> str:
    return (
        f"coalesce(list_avg({col}), 0::DOUBLE) AS {prefix}_mean, coalesce(list_stddev_pop({col}), 0::DOUBLE) AS {prefix}_std, "
        f"coalesce(list_max({col}), 0::DOUBLE) AS {prefix}_max"
    )


_FEATS = {
    **_LISTS,
    "feats": f"""SELECT flow_id, ts, src_ip, dst_ip, label, duration_ms::DOUBLE AS duration_ms, fwd_packets::DOUBLE AS fwd_packets, bwd_packets::DOUBLE AS bwd_packets,
  fwd_bytes::DOUBLE AS fwd_bytes, bwd_bytes::DOUBLE AS bwd_bytes, (fwd_packets + bwd_packets)::DOUBLE AS total_packets, (fwd_bytes + bwd_bytes)::DOUBLE AS total_bytes,
  (fwd_bytes + bwd_bytes) / secs AS bytes_per_second, (fwd_packets + bwd_packets) / secs AS packets_per_second,
  CASE WHEN fwd_bytes <> 0 THEN bwd_bytes::DOUBLE / fwd_bytes ELSE 0::DOUBLE END AS down_up_ratio,
  {_stats_sql('fl', 'fwd_pkt_len')}, {_stats_sql('bl', 'bwd_pkt_len')}, {_stats_sql('il', 'iat')},
  fwd_packets::DOUBLE AS syn_count, 0::DOUBLE AS fin_count, 1::DOUBLE AS rst_count, 0::DOUBLE AS psh_count, bwd_packets::DOUBLE AS ack_count, 0::DOUBLE AS urg_count,
  dst_port::DOUBLE AS dst_port, (dst_port BETWEEN 1 AND 1023)::INT::DOUBLE AS is_wellknown_port,
  (protocol = 'tcp')::INT::DOUBLE AS protocol_tcp, (protocol = 'udp')::INT::DOUBLE AS protocol_udp, 0::DOUBLE AS protocol_icmp FROM lists""",
}
_LOSSY = [f for f in fv.FLOW_FEATURES if f.endswith(("_mean", "_std", "_max", "_second", "_ratio"))]

_register(
    "n01_f26_f27_flow_features",
    lambda s, sf: _features(s, sf, spread=True).withColumns({f: sc.stable_round(F.col(f), 6) for f in _LOSSY}),
    with_views(["v_flow"], "SELECT * REPLACE (" + ", ".join(f"{_dec(f, 6)} AS {f}" for f in _LOSSY) + ") FROM feats", _FEATS),
)
_LOG_RULES = {
    "ruled": """SELECT *, count(source_ip) OVER (PARTITION BY batch_key, source_ip) AS k, upper(coalesce(flags, '')) AS f, upper(coalesce(protocol, '')) AS p FROM v_log""",
    "reasons": """SELECT *, CASE WHEN contains(f, 'SYN_FLOOD') OR len(regexp_extract_all(f, 'SYN')) >= 3 THEN 'syn_flood'
   WHEN packet_size > 8000 THEN 'oversized_packet' WHEN p = 'ICMP' AND k >= 4 THEN 'icmp_flood' WHEN source_ip IS NOT NULL AND k >= 6 THEN 'busy_source' END AS reason FROM ruled""",
}
_register(
    "w03_flow_rules",
    lambda s, sf: fl.flow_rules(view(s, sf, "v_log"), "batch_key").select("id", "batch_key", "from_source", "reason"),
    with_views(["v_log"], "SELECT id, batch_key, k AS from_source, reason FROM reasons", _LOG_RULES),
)
_TRIAGE = """
, o AS (SELECT *, row_number() OVER (PARTITION BY batch_key, reason IS NULL ORDER BY ts, id) AS rn FROM reasons),
b AS (SELECT batch_key, max(ts) AS ts, count(*) AS flows, count(reason) AS flagged, count(*) FILTER (WHERE reason = 'syn_flood') AS syn_flood,
  count(*) FILTER (WHERE reason = 'oversized_packet') AS oversized_packet, count(*) FILTER (WHERE reason = 'icmp_flood') AS icmp_flood, count(*) FILTER (WHERE reason = 'busy_source') AS busy_source,
  string_agg(id || '=' || reason, ', ' ORDER BY rn) FILTER (WHERE reason IS NOT NULL AND rn <= 6) AS listed FROM o GROUP BY 1),
t AS (SELECT batch_key, ts, flows, flagged, syn_flood, oversized_packet, icmp_flood, busy_source,
 CASE WHEN syn_flood + icmp_flood > 0 AND flagged >= 3 THEN 'Critical' WHEN syn_flood + icmp_flood > 0 OR flagged >= 4 THEN 'High' WHEN flagged >= 1 THEN 'Medium' ELSE 'Safe' END AS level,
 CASE WHEN syn_flood + icmp_flood > 0 AND flagged >= 3 THEN 'isolate_sources' WHEN syn_flood + icmp_flood > 0 OR flagged >= 4 THEN 'inspect_now' WHEN flagged >= 1 THEN 'review' ELSE 'none' END AS action,
 concat_ws(': ', flagged || ' of ' || flows || ' flows broke a rule', listed) AS report,
 'heuristic' AS score_source FROM b)"""
_register(
    "n02_f31_flow_triage",
    lambda s, sf: fl.flow_triage(view(s, sf, "v_log"), "batch_key"),
    with_views(["v_log"], _TRIAGE + " SELECT * FROM t", _LOG_RULES),
)
_register(
    "n02_flagged_flows",
    lambda s, sf: fl.flagged_flows(view(s, sf, "v_log"), "batch_key"),
    with_views(["v_log"], "SELECT batch_key, ts, id, reason, source_ip, packet_size FROM reasons WHERE reason IS NOT NULL", _LOG_RULES),
)
_register(
    "s06_u03_unified_detections",
    lambda s, sf: _unified(s, sf),
    with_views(["v_log", "v_detections"], _TRIAGE + f"""
SELECT ts, 1 AS tenant_id, 'network' AS module, lower(level) || '_anomaly' AS threat_type,
 CASE level WHEN 'Critical' THEN 0.95 WHEN 'High' THEN 0.75 WHEN 'Medium' THEN 0.5 ELSE 0.08 END::DOUBLE AS risk_score, NULL::VARCHAR AS ref_id, left(report, 180) AS summary FROM t
UNION ALL SELECT ts, tenant_id::INT, 'email', CASE WHEN risk_score >= 0.85 THEN 'phishing' WHEN risk_score >= 0.55 THEN 'suspicious' WHEN risk_score >= 0.25 THEN 'low_confidence' ELSE 'benign' END,
 {_dec('risk_score', 4)}, id::VARCHAR, CASE WHEN risk_score >= 0.85 THEN 'phishing' WHEN risk_score >= 0.55 THEN 'suspicious' WHEN risk_score >= 0.25 THEN 'low_confidence' ELSE 'benign' END || ': unknown sender'
 FROM v_detections WHERE module = 'email'""", _LOG_RULES),
)


def _unified(s, sf):
    network = sinks.network_detections(fl.flow_triage(view(s, sf, "v_log"), "batch_key").withColumn("tenant_id", F.lit(1)))
    mail = view(s, sf, "v_detections").filter("module = 'email'").select(
        "ts", F.col("tenant_id").cast("int").alias("tenant_id"), "risk_score", F.col("id").alias("ref_id"),
        sc.email_verdict(F.col("risk_score")).alias("verdict"), F.lit(None).cast("string").alias("from_addr"))
    return sinks.unify(network, sinks.email_detections(mail))


def _stored_detections(s, sf):
    """The unified rows by way of the stored table: two batches, one of them again, then all rows once more."""
    folder, rows = scratch_path(s, "detections"), _unified(s, sf)
    mail, network = rows.filter("module = 'email'"), rows.filter("module = 'network'")
    for batch, part in (("mail", mail), ("network", network), ("mail", mail), ("all", rows)):
        sinks.store_detections(part, folder, batch)
    return sinks.read_detections(s, folder)


_register("s06_detections_stored", _stored_detections, ORACLES["s06_u03_unified_detections"])


# --- logs written and read back ----------------------------------------------------------

_LOG_NAMES = {  # two layouts of the same log; the second repeats a name, whose last column counts
    0: "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto duration orig_ip_bytes resp_ip_bytes orig_pkts resp_pkts history".split(),
    1: "uid proto id.resp_h id.resp_p duration id.orig_h id.orig_p orig_pkts resp_pkts orig_ip_bytes resp_ip_bytes ts history uid".split(),
}


def _conn_log(s, sf):
    """The flows as connection logs of alternating layouts, every tenth as JSON, read back."""
    flows = view(s, sf, "v_flow").withColumn("block", F.floor(F.col("flow_id") / 2000))
    micros = F.unix_micros("ts")
    values = {
        "ts": F.format_string("%d.%06d", F.floor(micros / 1000000), F.pmod(micros, F.lit(1000000))), "uid": F.concat(F.lit("C"), "flow_id"),
        "id.orig_h": F.col("src_ip"), "id.orig_p": F.lit("50000"), "id.resp_h": F.col("dst_ip"), "id.resp_p": F.col("dst_port").cast("string"),
        "proto": F.col("protocol"), "duration": (F.col("duration_ms") / 1000).cast("string"), "orig_ip_bytes": F.col("fwd_bytes").cast("string"),
        "resp_ip_bytes": F.col("bwd_bytes").cast("string"), "orig_pkts": F.col("fwd_packets").cast("string"), "resp_pkts": F.col("bwd_packets").cast("string"),
        "history": F.lit("ShADadFf"),
    }
    layout = {n: F.concat_ws("\t", *[F.lit("-") if i < len(names) - 1 and name in names[i + 1 :] else values[name] for i, name in enumerate(names)]) for n, names in _LOG_NAMES.items()}
    odd = F.col("block") % 2 == 1
    as_json = F.to_json(F.struct(*[c.alias(n) for n, c in values.items()]))
    line = F.when(F.col("flow_id") % 10 == 0, as_json).when(odd, layout[1]).otherwise(layout[0])
    header = F.concat(F.lit("#fields\t"), F.when(odd, F.lit("\t".join(_LOG_NAMES[1]))).otherwise(F.lit("\t".join(_LOG_NAMES[0]))))
    headers = flows.select("block").distinct().select("block", F.lit(-1).cast("long").alias("at"), header.alias("line"))
    lines = flows.select("block", F.col("flow_id").cast("long").alias("at"), line.alias("line")).unionByName(headers)
    folder = scratch_path(s, "conn-logs")
    lines.repartition("block").sortWithinPartitions("block", "at").select("line").write.text(folder)
    flags = F.col("tcp_flags")
    return flow_files.read_conn_log(s, folder, range_bytes=1 << 20).select(
        "flow_id", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", sc.stable_round(F.col("duration_ms"), 6).alias("duration_ms"),
        "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", *[flags[f].alias(f) for f in ("syn", "fin", "rst", "ack", "psh")])


_register(
    "s01_conn_log",
    _conn_log,
    with_views(["v_flow"], f"""
SELECT 'C' || flow_id AS flow_id, ts, src_ip, dst_ip, 50000::INT AS src_port, dst_port::INT AS dst_port, protocol, {_dec('duration_ms', 6)} AS duration_ms,
 fwd_packets::BIGINT AS fwd_packets, bwd_packets::BIGINT AS bwd_packets, fwd_bytes::BIGINT AS fwd_bytes, bwd_bytes::BIGINT AS bwd_bytes,
 1::INT AS syn, 2::INT AS fin, 0::INT AS rst, 2::INT AS ack, 0::INT AS psh FROM v_flow"""),
)


def _cic_files(s, sf):
    """The flows as CSV files of three headers below one folder, read back."""
    flows = view(s, sf, "v_flow")
    columns = {
        " Destination Port": F.col("dst_port"), "Flow  Duration": F.col("duration_ms") * 1000, "Total Fwd Packets": F.col("fwd_packets"),
        "Total Backward Packets": F.col("bwd_packets"), "Total Length of Fwd Packets": F.col("fwd_bytes"), "Total Length of Bwd Packets": F.col("bwd_bytes"),
        "Protocol": F.when(F.col("protocol") == "tcp", 6).otherwise(17), " Label": F.lower("label"),
    }
    orders = (list(columns), list(reversed(columns)), [n for n in columns if n != "Protocol"])
    folder = scratch_path(s, "cic-files")
    for number, names in enumerate(orders):
        flows.filter(F.col("flow_id") % 3 == number).select(*[columns[n].alias(n) for n in names]).write.csv(f"{folder}/day{number}", header=True, ignoreLeadingWhiteSpace=False)
    rows = flow_files.read_cic_csv(s, folder)
    return rows.select(
        "dst_port", sc.stable_round(F.col("duration_ms"), 6).alias("duration_ms"), "fwd_packets", "bwd_packets", "total_packets", "fwd_bytes", "bwd_bytes", "total_bytes",
        "is_wellknown_port", "protocol_tcp", "protocol_udp", "iat_max", "label")


_register(
    "s02_cic_csv",
    _cic_files,
    with_views(["v_flow"], f"""
SELECT dst_port::DOUBLE AS dst_port, {_dec('duration_ms', 6)} AS duration_ms, fwd_packets::DOUBLE AS fwd_packets, bwd_packets::DOUBLE AS bwd_packets,
 (fwd_packets + bwd_packets)::DOUBLE AS total_packets, fwd_bytes::DOUBLE AS fwd_bytes, bwd_bytes::DOUBLE AS bwd_bytes, (fwd_bytes + bwd_bytes)::DOUBLE AS total_bytes,
 (dst_port BETWEEN 1 AND 1023)::INT::DOUBLE AS is_wellknown_port, (protocol = 'tcp' AND flow_id % 3 <> 2)::INT::DOUBLE AS protocol_tcp,
 (protocol = 'udp' AND flow_id % 3 <> 2)::INT::DOUBLE AS protocol_udp, 0::DOUBLE AS iat_max, upper(coalesce(label, '')) AS label FROM v_flow"""),
)


# --- scaling, thresholds, ensemble ------------------------------------------------------

_SCALED = ("duration_ms", "fwd_packets", "bytes_per_second", "iat_std", "fin_count")


def _scaler_rows(s, sf):
    # The statistics stay on the executors: the one scaler row is unfolded, not collected.
    row = fl.scaler(_features(s, sf).drop("label"))
    unfolded = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"{f}.mean").alias("mean"), F.col(f"{f}.std").alias("std")) for f in fl.FEATURES]))
    return row.select(unfolded.alias("r")).select("r.feature", sc.stable_round(F.col("r.mean"), 4).alias("mean"), sc.stable_round(F.col("r.std"), 4).alias("std"))


_register(
    "a17_scaler",
    _scaler_rows,
    with_views(["v_flow"], " UNION ALL ".join(
        [f"SELECT '{f}' AS feature, {_dec(f'avg({f})', 4)} AS mean, {_dec(f'CASE WHEN stddev_pop({f}) < 1e-9 THEN 1 ELSE stddev_pop({f}) END', 4)} AS std FROM feats" for f in fv.FLOW_FEATURES]), _FEATS),
)


def _percentiles(s, sf):
    v = view(s, sf, "v_flow").select("raw_value")
    rows = [(q, bl.exact_percentile(v, "raw_value", q)) for q in (0.5, 0.9, 0.99)]
    return s.createDataFrame(rows, "q double, value double").withColumn("value", sc.stable_round(F.col("value"), 6))


_register(
    "a18_percentile_threshold",
    _percentiles,
    with_views(["v_flow"], " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, {_dec(f'quantile_cont(raw_value, {q})', 6)} AS value FROM v_flow" for q in (0.5, 0.9, 0.99))),
)


def _two_scores(s, sf):
    return view(s, sf, "v_flow").select("flow_id", F.col("raw_value").alias("forest_raw"), (F.col("fwd_packets") * F.col("raw_value")).alias("error_raw"))


def _ensemble(s, sf):
    scores = _two_scores(s, sf)
    r = scores.agg(F.min("forest_raw"), F.max("forest_raw"), F.min("error_raw"), F.max("error_raw")).first()
    combined = fl.ensemble(fl.min_max(F.col("forest_raw"), r[0], r[1]), fl.min_max(F.col("error_raw"), r[2], r[3]))
    out = scores.withColumn("combined", combined)
    threshold = bl.exact_percentile(out, "combined", 0.99)
    return out.select("flow_id", sc.stable_round(F.col("combined"), 4).alias("score"), (F.round("combined", 12) >= round(threshold, 12)).alias("is_anomaly"))


_ENSEMBLE = """
, sc AS (SELECT flow_id, raw_value AS a, fwd_packets * raw_value AS b FROM v_flow),
rf AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb FROM sc),
cm AS (SELECT flow_id, round(greatest(0, least(1, ((a - la) / (ha - la) + (b - lb) / (hb - lb)) / 2)), 12) AS c FROM sc CROSS JOIN rf)
"""
_register(
    "n06_a19_f25_ensemble",
    _ensemble,
    with_views(["v_flow"], _ENSEMBLE + f"SELECT flow_id, {_dec('c', 4)} AS score, c >= (SELECT round(quantile_cont(c, 0.99), 12) FROM cm) AS is_anomaly FROM cm"),
)


def _attributed(s, sf):
    features = _features(s, sf)
    row = fl.scaler(features).first()
    scaled = fl.scale(features, {f: row[f]["mean"] for f in fl.FEATURES}, {f: row[f]["std"] for f in fl.FEATURES})
    # Ranked on rounded z-scores here, so that both engines break ties alike.
    scaled = scaled.withColumns({f: F.round(f, 6) for f in fl.FEATURES})
    listed = F.transform(fl.attribution(), lambda a: F.concat(a["feature"], F.lit(":"), a["direction"]))
    return scaled.select("flow_id", F.concat_ws(" ", listed).alias("attribution"), sc.stable_round(F.col("iat_max"), 4).alias("iat_max"))


_register(
    "n07_f24_attribution",
    _attributed,
    with_views(["v_flow"], ", st AS (SELECT " + ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) < 1e-9 THEN 1 ELSE stddev_pop({f}) END AS d_{f}" for f in fv.FLOW_FEATURES) + " FROM feats), z AS (SELECT flow_id, ["
        + ", ".join(f"{{'f': '{f}', 'i': {i}, 'z': {_dec(f'greatest(-10, least(10, ({f} - m_{f}) / d_{f}))', 6)}}}" for i, f in enumerate(fv.FLOW_FEATURES))
        + f"""] AS zs, {_dec(_dec('greatest(-10, least(10, (iat_max - m_iat_max) / d_iat_max))', 6), 4)} AS iat_max FROM feats CROSS JOIN st),
u AS (SELECT flow_id, unnest(zs) AS e FROM z), r AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY abs(e.z) DESC, e.i) AS rn FROM u)
SELECT r.flow_id, coalesce(string_agg(e.f || ':' || CASE WHEN e.z > 0 THEN 'high' ELSE 'low' END, ' ' ORDER BY rn) FILTER (WHERE rn <= 5 AND abs(e.z) >= 1), '') AS attribution, any_value(z.iat_max) AS iat_max
FROM r JOIN z ON z.flow_id = r.flow_id GROUP BY 1""", _FEATS),
)

# --- evaluation -------------------------------------------------------------------------


def _scored(s, sf):
    return view(s, sf, "v_scored").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_CONF = """SELECT count(*) AS n, count(*) FILTER (WHERE y=1 AND p=1) AS tp, count(*) FILTER (WHERE y=0 AND p=1) AS fp, count(*) FILTER (WHERE y=1 AND p=0) AS fn, count(*) FILTER (WHERE y=0 AND p=0) AS tn FROM {t}"""
_METRICS = f"""n, tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
 {_dec('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 4)} AS precision, {_dec('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 4)} AS recall,
 {_dec('coalesce(2 * (tp::DOUBLE / nullif(tp + fp, 0)) * (tp::DOUBLE / nullif(tp + fn, 0)) / nullif(tp::DOUBLE / nullif(tp + fp, 0) + tp::DOUBLE / nullif(tp + fn, 0), 0), 0)', 4)} AS f1,
 {_dec('coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0)', 4)} AS false_positive_rate"""
_AUC = """rk AS (SELECT y, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM {t}),
ag AS (SELECT sum(r) FILTER (WHERE y = 1) AS sr, (count(*) FILTER (WHERE y = 1))::DOUBLE AS np, (count(*) FILTER (WHERE y = 0))::DOUBLE AS nn FROM rk),
stp AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS cnt FROM {t} GROUP BY 1),
cu AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(cnt) OVER (ORDER BY score DESC) AS k FROM stp),
rank_metrics AS (SELECT round(((sr - np * (np + 1) / 2) / (np * nn))::DECIMAL(38,12), 4)::DOUBLE AS auc_roc,
  (SELECT round((sum(pos * tp / k) / sum(pos))::DECIMAL(38,12), 4)::DOUBLE FROM cu) AS avg_precision FROM ag)"""
_register(
    "a21_confusion_metrics",
    lambda s, sf: fl.confusion_metrics(_scored(s, sf)),
    with_views(["v_scored"], f", p AS (SELECT y, (score >= 0.5)::INT AS p FROM v_scored), c AS ({_CONF.format(t='p')}) SELECT {_METRICS} FROM c"),
)
_register(
    "a22_a23_ranking_metrics",
    lambda s, sf: fl.ranking_metrics(_scored(s, sf)),
    with_views(["v_scored"], ", " + _AUC.format(t="v_scored") + " SELECT * FROM rank_metrics"),
)


def _evaluated(s, sf):
    flows = view(s, sf, "v_flow").select("label", F.least(F.col("raw_value") / 300, F.lit(1.0)).alias("s"))
    return fl.evaluate(flows.select("label", sc.stable_round(F.col("s"), 4).alias("score"), (F.col("s") >= 0.5).alias("is_anomaly")))


_register(
    "n09_evaluate",
    _evaluated,
    with_views(["v_flow"], f"""
, e AS (SELECT (upper(label) NOT IN ('BENIGN','NORMAL'))::INT AS y, {_dec('least(raw_value / 300, 1)', 4)} AS score, (raw_value / 300 >= 0.5)::INT AS p FROM v_flow WHERE label IS NOT NULL),
c AS ({_CONF.format(t='e')}), {_AUC.format(t='e')}
SELECT {_METRICS}, auc_roc, avg_precision, NULL::VARCHAR AS error FROM c CROSS JOIN rank_metrics"""),
)


def _split_counts(s, sf):
    train, test = fl.benign_split(view(s, sf, "v_flow"), "flow_id")
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    # The share of a hashed side is checked, not its members: the hash is Spark's own.
    rows = both.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("flow_id").alias("ids"), F.avg((F.col("side") == "train").cast("double")).alias("share"))
    return rows.select("label", "n", "ids", F.when(F.col("label") == "BENIGN", F.abs(F.col("share") - 0.7) < 0.05).otherwise(F.col("share") == 0).alias("share_ok"))


_register(
    "n10_benign_split",
    _split_counts,
    with_views(["v_flow"], "SELECT label, count(*) AS n, count(DISTINCT flow_id) AS ids, true AS share_ok FROM v_flow WHERE label IS NOT NULL GROUP BY 1"),
)

# --- model, incidents -------------------------------------------------------------------


def _benign(features):
    return features.filter("label = 'BENIGN'")


def _fit(s, sf):
    features = _features(s, sf, spread=True)
    model = bl.fit_baseline(_benign(features))
    return s.createDataFrame([(float(model.threshold), model.info["n_flows"], model.info["reconstruction"])], "threshold double, n_flows long, reconstruction boolean")


def _score(s, sf):
    features = _features(s, sf, spread=True)
    return bl.score_flows(features, bl.fit_baseline(_benign(features)))


AUC_FLOOR = 0.85


def _trained(s, sf):
    """Split, fit, store, load, score and evaluate; the share and the model are Spark's own, so
    the counts that don't depend on them are compared, and the rest against its floor."""
    path = scratch_path(s, "flow-baseline")
    scored = bl.train_and_evaluate(_features(s, sf, spread=True), path)
    stored = bl.registered_metrics(s, path)
    again = bl.score_flows(_features(s, sf, spread=True), bl.FlowBaseline.load(s, path)).select("flow_id", F.col("score").alias("again"))
    judged = scored.join(again, "flow_id").agg(
        F.count_if(fl.is_attack(F.col("label")) == 1).alias("attacks"),
        (F.avg(F.when(F.col("label") == "ATTACK", F.col("score"))) > F.avg(F.when(F.col("label") == "BENIGN", F.col("score")))).alias("attacks_score_higher"),
        F.bool_and(F.abs(F.col("score") - F.col("again")) < 1e-9).alias("stored_model_agrees"),
        F.bool_and(F.col("score").between(0, 1) & ((F.col("is_anomaly") == (F.col("score") >= F.col("threshold"))) | (F.abs(F.col("score") - F.col("threshold")) < 2e-4))).alias("scores_hold"),
    )
    return judged.withColumn("auc_reached", F.lit(stored["auc_roc"] >= AUC_FLOOR)).withColumn("all_judged", F.lit(stored["n"]) == F.lit(scored.count()))


_register(
    "n10_n03_n06_n09_train_evaluate",
    _trained,
    with_views(["v_flow"], """SELECT count(*) AS attacks, true AS attacks_score_higher, true AS stored_model_agrees, true AS scores_hold, true AS auc_reached, true AS all_judged
 FROM v_flow WHERE label = 'ATTACK'"""),
)
_register("n03_n04_n05_fit_baseline", _fit)
_register("n06_score_flows", lambda s, sf: _score(s, sf).select("flow_id", "label", "score", "is_anomaly", "threshold"))
_register("n08_cluster_incidents", lambda s, sf: cl.cluster_incidents(_score(s, sf)).select("cluster_id", "member_count", "max_score", "mean_score", "severity", "source_count", "dest_count", "first_seen", "last_seen"))


def _clusters(s, sf):
    """All flows labelled as attacks, as behaviour vectors with three deviating features."""
    attacks = view(s, sf, "v_flow").filter("label = 'ATTACK'")
    z = {"duration_ms": (F.col("raw_value") - 200) / 50, "fwd_packets": (F.col("fwd_packets") - 20) / 5, "bwd_packets": (F.col("bwd_packets") - 30) / 10}
    named = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("z_score")) for f, c in z.items()])
    rows = attacks.select(F.col("flow_id").alias("id"), cl.behaviour_vector(F.col("raw_value") / 500, named).alias("raw"))
    return cl.dbscan(rows, eps=0.02, min_samples=3).withColumnRenamed("id", "flow_id")


_register(
    "j10_n08_dbscan",
    _clusters,
    with_views(["v_flow"], """
, a AS (SELECT flow_id, raw_value / 500 AS s, (raw_value - 200) / 50 AS x, (fwd_packets - 20) / 5 AS y, (bwd_packets - 30) / 10 AS z FROM v_flow WHERE label = 'ATTACK'),
v AS (SELECT flow_id, s / n AS s, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(s*s + x*x + y*y + z*z) AS n FROM a)),
near AS (SELECT p.flow_id AS p, q.flow_id AS q FROM v p JOIN v q ON 1 - (p.s*q.s + p.x*q.x + p.y*q.y + p.z*q.z) <= 0.02 + 1e-12),
core AS (SELECT p FROM near GROUP BY p HAVING count(*) >= 3),
link AS (SELECT p, q FROM near WHERE p IN (SELECT p FROM core) AND q IN (SELECT p FROM core)),
reach AS (SELECT p AS node, p AS seen FROM core UNION SELECT r.node, l.q FROM reach r JOIN link l ON l.p = r.seen),
comp AS (SELECT node, min(seen) AS cluster_id FROM reach GROUP BY 1)
SELECT node AS flow_id, cluster_id FROM comp
UNION ALL SELECT n.p, min(c.cluster_id) FROM near n JOIN comp c ON c.node = n.q WHERE n.p NOT IN (SELECT p FROM core) GROUP BY 1""").replace("WITH ", "WITH RECURSIVE ", 1),
)


def _vectors(flows):
    """Behaviour vectors with three deviating features, and what an incident needs of a scored flow."""
    z = {"duration_ms": (F.col("raw_value") - 200) / 50, "fwd_packets": (F.col("fwd_packets") - 20) / 5, "bwd_packets": (F.col("bwd_packets") - 30) / 10}
    named = F.array(*[F.struct(F.lit(f).alias("feature"), c.alias("z_score")) for f, c in z.items()])
    return flows.select("flow_id", "ts", "src_ip", "dst_ip", "raw_value", (F.col("raw_value") / 500).alias("score"), named.alias("attribution"))


def _clusters_of_all(s, sf):
    """All flows at two reaches."""
    rows = _vectors(view(s, sf, "v_flow")).select(F.col("flow_id").alias("id"), cl.behaviour_vector(F.col("score"), F.col("attribution")).alias("raw"))
    found = [cl.dbscan(rows, eps=eps, min_samples=3).withColumn("eps", F.lit(eps)) for eps in _EPS]
    return found[0].unionByName(found[1]).withColumnRenamed("id", "flow_id")


_EPS = (0.0002, 0.002)
_INCIDENT_EPS = 0.002


def _dbscan_sql(name: str, eps: float, where: str) -> dict[str, str]:
    """CTEs up to ``<name>_found``: flow_id and the least core flow of its cluster."""
    return {
        f"{name}_v": f"""SELECT flow_id, s / n AS s, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(s*s + x*x + y*y + z*z) AS n FROM
   (SELECT flow_id, raw_value / 500 AS s, (raw_value - 200) / 50 AS x, (fwd_packets - 20) / 5 AS y, (bwd_packets - 30) / 10 AS z FROM v_flow WHERE {where}))""",
        f"{name}_near": f"SELECT p.flow_id AS p, q.flow_id AS q FROM {name}_v p JOIN {name}_v q ON 1 - (p.s*q.s + p.x*q.x + p.y*q.y + p.z*q.z) <= {eps} + 1e-12",
        f"{name}_core": f"SELECT p FROM {name}_near GROUP BY p HAVING count(*) >= 3",
        f"{name}_link": f"SELECT p, q FROM {name}_near WHERE p IN (SELECT p FROM {name}_core) AND q IN (SELECT p FROM {name}_core) AND p <> q",
        f"{name}_comp(node, cluster_id) USING KEY (node)": f"""SELECT p, p FROM {name}_core UNION (SELECT DISTINCT ON (u.node) u.node, v.cluster_id
   FROM recurring.{name}_comp u, {name}_comp v, {name}_link e WHERE e.p = u.node AND e.q = v.node AND v.cluster_id < u.cluster_id ORDER BY u.node, v.cluster_id)""",
        f"{name}_found": f"""SELECT node AS flow_id, cluster_id FROM {name}_comp
   UNION ALL SELECT n.p, min(c.cluster_id) FROM {name}_near n JOIN {name}_comp c ON c.node = n.q WHERE n.p NOT IN (SELECT p FROM {name}_core) GROUP BY 1""",
    }


_register(
    "j10_n08_dbscan_all_flows",
    _clusters_of_all,
    with_views(["v_flow"], " UNION ALL ".join(f"SELECT flow_id, cluster_id, {eps}::DOUBLE AS eps FROM e{i}_found" for i, eps in enumerate(_EPS)),
               _dbscan_sql("e0", _EPS[0], "true") | _dbscan_sql("e1", _EPS[1], "true")).replace("WITH ", "WITH RECURSIVE ", 1),
)


def _incidents(s, sf):
    scored = _vectors(view(s, sf, "v_flow")).withColumn("is_anomaly", F.col("raw_value") >= 100)
    out = cl.cluster_incidents(scored, eps=_INCIDENT_EPS)
    return out.select("cluster_id", "member_count", "max_score", "severity", "source_count", "dest_count", "first_seen", "last_seen")


_register(
    "n08_incidents_of_scores",
    _incidents,
    with_views(["v_flow"], f"""SELECT min(f.flow_id) AS cluster_id, count(*) AS member_count, {_dec('max(raw_value / 500)', 4)} AS max_score,
 CASE WHEN max(raw_value / 500) > 0.9 THEN 'critical' WHEN max(raw_value / 500) > 0.75 THEN 'high' WHEN max(raw_value / 500) > 0.5 THEN 'medium' ELSE 'low' END AS severity,
 count(DISTINCT src_ip) AS source_count, count(DISTINCT dst_ip) AS dest_count, min(ts) AS first_seen, max(ts) AS last_seen
 FROM i_found f JOIN v_flow USING (flow_id) GROUP BY f.cluster_id""", _dbscan_sql("i", _INCIDENT_EPS, "raw_value >= 100")).replace("WITH ", "WITH RECURSIVE ", 1),
)


def _rollup(s, sf):
    """Roll-up over given clusters: the flows of a port and protocol."""
    v = view(s, sf, "v_flow")
    members = v.select(
        F.col("dst_port").alias("cluster_id"), sc.stable_round(F.least(F.col("raw_value") / 300, F.lit(1.0)), 4).alias("score"), "ts", "src_ip", "dst_ip",
        F.when(F.col("flow_id") % 2 == 0, F.array(F.struct(F.lit("iat_max").alias("feature")), F.struct(F.concat(F.lit("f"), F.col("flow_id") % 7).alias("feature")))).otherwise(
            F.array(F.struct(F.lit("dst_port").alias("feature")))).alias("attribution"))
    out = fl.incident_rollup(members)
    return out.withColumns({
        "source_ips": F.concat_ws(" ", "source_ips"), "dest_ips": F.concat_ws(" ", "dest_ips"),
        "shared_features": F.concat_ws(" ", F.transform("shared_features", lambda e: F.concat(e["feature"], F.lit(":"), e["n"].cast("string"))))})


_register(
    "a20_a25_incident_rollup",
    _rollup,
    with_views(["v_flow"], f"""
, m AS (SELECT dst_port AS cluster_id, {_dec('least(raw_value / 300, 1)', 4)} AS score, ts, src_ip, dst_ip,
   CASE WHEN flow_id % 2 = 0 THEN ['iat_max', 'f' || flow_id % 7] ELSE ['dst_port'] END AS attrs FROM v_flow),
b AS (SELECT cluster_id, count(*) AS member_count, max(score) AS max_score, {_dec('avg(score)', 4)} AS mean_score, min(ts) AS first_seen, max(ts) AS last_seen,
  CASE WHEN max(score) > 0.9 THEN 'critical' WHEN max(score) > 0.75 THEN 'high' WHEN max(score) > 0.5 THEN 'medium' ELSE 'low' END AS severity,
  count(DISTINCT src_ip) AS source_count, count(DISTINCT dst_ip) AS dest_count,
  array_to_string(list_sort(list_distinct(list(src_ip)))[1:20], ' ') AS source_ips, array_to_string(list_sort(list_distinct(list(dst_ip)))[1:20], ' ') AS dest_ips FROM m GROUP BY 1),
fc AS (SELECT cluster_id, f, count(*) AS n FROM (SELECT cluster_id, unnest(attrs) AS f FROM m) GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, f) AS r FROM fc)
SELECT b.*, s.shared_features FROM b LEFT JOIN (SELECT cluster_id, string_agg(f || ':' || n, ' ' ORDER BY r) AS shared_features FROM fr WHERE r <= 5 GROUP BY 1) s ON s.cluster_id = b.cluster_id"""),
)
