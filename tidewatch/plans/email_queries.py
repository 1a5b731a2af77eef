"""Registered e-mail queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import domains as dm
from tidewatch.functions import fixed_values as fv
from tidewatch.functions import scoring as sc
from tidewatch.operators import email as em
from tidewatch.plans import oracle_sql as osql
from tidewatch.plans.standins import table, view, with_views
from tidewatch.session import scratch_path
from tidewatch.sources import messages as ms
from tidewatch.sources import sinks
from tidewatch.sources.stored import stored

QUERIES = {}
ORACLES = {}


def _register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


def _signals(s, sf):
    """The two e-mail stand-ins in the shape of the parser's output."""
    mail = view(s, sf, "v_email", spread=True).select("id", "from_host", "spf", "dkim", "dmarc", "dkim_aligned")
    parsed = view(s, sf, "v_email_parsed", spread=True)
    return (
        mail.join(parsed, "id")
        .select(
            F.col("id").alias("msg_id"), "from_display", "subject", "plain", "html", "spf", "dkim", "dmarc", "dkim_aligned",
            "hop_count", "private_ip_hops", "max_hop_gap_seconds",
            dm.registrable_domain(F.col("from_host")).alias("from_domain"),
            dm.registrable_domain(F.col("reply_to_host")).alias("reply_to_domain"),
            dm.registrable_domain(F.col("return_path_host")).alias("return_path_domain"),
            F.when(F.col("attachment_ext").isNotNull(), F.array(F.struct(
                F.concat(F.lit("file."), "attachment_ext").alias("filename"), F.col("attachment_ext").alias("extension")))
            ).otherwise(F.array().cast("array<struct<filename:string,extension:string>>")).alias("attachments"),
        )
        .transform(em.derive_signals)
    )


_LOW = "lower(coalesce(subject,'') || ' ' || body)"
_HITS = ", ".join(f"{osql.hits(_LOW, p)} AS hits_{c}" for c, p in fv.PRESSURE_PHRASES.items())
_CATS = " + ".join(f"(hits_{c} > 0)::INT" for c in fv.PRESSURE_PHRASES)
_TOTAL = " + ".join(f"hits_{c}" for c in fv.PRESSURE_PHRASES)
_TOKEN = fv.PATTERN_DOMAIN_TOKEN.replace("(?i)", "")
_BASE = {
    "joined": f"""SELECT m.id AS msg_id, m.spf, m.dkim, m.dmarc, m.dkim_aligned, p.* EXCLUDE (id),
   {osql.registrable('m.from_host')} AS from_domain, {osql.registrable('p.reply_to_host')} AS reply_to_domain, {osql.registrable('p.return_path_host')} AS return_path_domain,
   trim(regexp_replace(CASE WHEN plain <> '' THEN plain ELSE regexp_replace(html, '<[^>]+>', ' ', 'g') END, '\\s+', ' ', 'g')) AS body
 FROM v_email m JOIN v_email_parsed p ON p.id = m.id""",
    "sig": f"""SELECT *, {_HITS}, contains(plain, 'http') AS ip_link, contains(html, 'http') AS short_link, string_split(from_domain, '.')[1] AS label,
   regexp_extract(from_display, '{_TOKEN}', 1, 'i') AS token FROM joined""",
    "s": f"""SELECT *, CASE WHEN from_domain IS NOT NULL AND length(label) >= 4 THEN {osql.brand_hit('label')} END AS key,
   {osql.registrable('token')} AS claimed FROM sig""",
}
_BRANDS = osql.str_list(fv.BRANDS)
_FIRST_BRAND = f"list_filter({_BRANDS}, lambda b: contains(lower(from_display), b))[1]"
_FLAG = {
    "spf_fail": "coalesce(spf IN ('fail','softfail'), false)",
    "no_auth": "coalesce(spf, dkim, dmarc) IS NULL",
    "reply": "coalesce(reply_to_domain <> from_domain, false)",
    "ret": "coalesce(return_path_domain <> from_domain, false)",
    "look": "coalesce(key // 64 BETWEEN 1 AND 2, false)",
}

_register(
    "e03_email_features",
    lambda s, sf: em.email_features(_signals(s, sf)).withColumn("html_to_text_ratio", sc.stable_round(F.col("html_to_text_ratio"), 6)),
    with_views(["v_email", "v_email_parsed"], f"""
SELECT msg_id, coalesce(spf = 'pass', false)::INT AS spf_pass, {_FLAG['spf_fail']}::INT AS spf_fail,
 coalesce(dkim = 'pass', false)::INT AS dkim_pass, coalesce(dkim = 'fail', false)::INT AS dkim_fail,
 coalesce(dmarc = 'pass', false)::INT AS dmarc_pass, coalesce(dmarc = 'fail', false)::INT AS dmarc_fail,
 coalesce(dkim_aligned, false)::INT AS dkim_aligned, (NOT {_FLAG['no_auth']})::INT AS auth_present,
 {_FLAG['reply']}::INT AS reply_to_mismatch, {_FLAG['ret']}::INT AS return_path_mismatch,
 coalesce(from_domain IN {fv.FREEMAIL}, false)::INT AS from_is_freemail, {_FLAG['look']}::INT AS from_lookalike,
 length(coalesce(from_display, ''))::INT AS display_name_len, hop_count, private_ip_hops, max_hop_gap_seconds,
 (ip_link::INT + short_link::INT) AS url_count, (ip_link::INT + short_link::INT) AS url_unique_domains,
 short_link::INT AS url_anchor_mismatches, 0 AS url_punycode, 0 AS url_lookalikes, short_link::INT AS url_shorteners,
 ip_link::INT AS url_ip_literals, CASE WHEN ip_link THEN 2 ELSE 0 END AS url_max_subdomain_depth,
 (attachment_ext IS NOT NULL)::INT AS attachment_count, coalesce(attachment_ext = 'exe', false)::INT AS dangerous_attachments,
 coalesce(attachment_ext = 'docm', false)::INT AS macro_attachments, length(body)::INT AS body_length, length(coalesce(subject,''))::INT AS subject_length,
 ({_CATS})::INT AS lexicon_categories, ({_TOTAL})::INT AS lexicon_hits, (html <> '')::INT AS has_html,
 CASE WHEN plain <> '' THEN round((length(html)::DOUBLE / length(plain))::DECIMAL(38,12), 6)::DOUBLE ELSE (html <> '')::INT::DOUBLE END AS html_to_text_ratio,
 (starts_with(lower(subject), 're:') OR starts_with(lower(subject), 'fwd:'))::INT AS subject_is_reply FROM s""", _BASE),
)

_RULES = [
    (_FLAG["spf_fail"], "SPF_FAIL", "high", "0.25"),
    ("coalesce(dkim = 'fail', false)", "DKIM_FAIL", "high", "0.25"),
    ("coalesce(dmarc = 'fail', false)", "DMARC_FAIL", "critical", "0.35"),
    ("dkim_aligned IS FALSE", "DKIM_MISALIGNED", "critical", "0.35"),
    (_FLAG["no_auth"], "NO_AUTH_RESULTS", "low", "0.05"),
    ("coalesce(claimed <> '' AND claimed <> from_domain, false)", "DISPLAY_NAME_SPOOF", "high", "0.25"),
    (f"coalesce(NOT contains(from_domain, {_FIRST_BRAND}) AND from_domain IN {fv.FREEMAIL}, false)", "BRAND_FROM_FREEMAIL", "high", "0.30"),
    (_FLAG["reply"], "REPLY_TO_MISMATCH", "medium", "0.18"),
    (_FLAG["ret"], "RETURN_PATH_MISMATCH", "medium", "0.12"),
    (_FLAG["look"], "LOOKALIKE_SENDER_DOMAIN", "critical", "0.35"),
    ("short_link", "URL_ANCHOR_MISMATCH", "high", "0.25"),
    ("short_link", "URL_SHORTENER", "medium", "0.12"),
    ("ip_link", "URL_IP_LITERAL", "high", "0.22"),
    ("coalesce(attachment_ext = 'exe', false)", "DANGEROUS_ATTACHMENT", "critical", "0.40"),
    ("coalesce(attachment_ext = 'docm', false)", "MACRO_ATTACHMENT", "high", "0.25"),
    (f"({_CATS}) >= 2", "PRESSURE_LANGUAGE", "medium", f"least(0.20::DOUBLE, 0.06::DOUBLE * ({_CATS}))"),
    ("hits_credential_bait > 0 AND (ip_link OR short_link)", "CREDENTIAL_HARVEST_PATTERN", "high", "0.25"),
    ("private_ip_hops > 0 AND hop_count > 1", "PRIVATE_IP_IN_CHAIN", "info", "0.02"),
]
_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {cond} THEN {{'code': '{code}', 'severity': '{sev}', 'weight': ({w})::DOUBLE}} END" for cond, code, sev, w in _RULES
) + "], lambda r: r IS NOT NULL)"

_register(
    "e04_email_indicators",
    lambda s, sf: em.email_indicators(_signals(s, sf)).select("msg_id", "code", "severity", sc.stable_round(F.col("weight"), 6).alias("weight")),
    with_views(["v_email", "v_email_parsed"], f"""
, i AS (SELECT msg_id, unnest({_LIST}) AS r FROM s)
SELECT msg_id, r.code AS code, r.severity AS severity, round(r.weight::DECIMAL(38,12), 6)::DOUBLE AS weight FROM i""", _BASE),
)
_FUSED = "1 - list_reduce(list_prepend(1.0::DOUBLE, list_transform(l, lambda r: 1.0::DOUBLE - r.weight)), lambda a, b: a * b)"
_register(
    "a15_e05_email_risk",
    lambda s, sf: em.email_risk(_signals(s, sf)).select("msg_id", "risk_score", "verdict", "score_source"),
    with_views(["v_email", "v_email_parsed"], f"""
, i AS (SELECT msg_id, {_LIST} AS l FROM s),
r AS (SELECT msg_id, round(least({_FUSED}, 0.99::DOUBLE)::DECIMAL(38,12), 4)::DOUBLE AS risk_score FROM i)
SELECT *, CASE WHEN risk_score >= 0.85 THEN 'phishing' WHEN risk_score >= 0.55 THEN 'suspicious' WHEN risk_score >= 0.25 THEN 'low_confidence' ELSE 'benign' END AS verdict,
 'heuristic' AS score_source FROM r""", _BASE),
)
_register(
    "a15_noisy_or_by_code",
    lambda s, sf: view(s, sf, "v_detections").groupBy("tenant_id", "module").agg(sc.noisy_or_agg(F.col("risk_score") / 100).alias("fused")),
    with_views(["v_detections"], """
SELECT tenant_id, module, round(least(1 - product(1.0::DOUBLE - risk_score / 100), 0.99::DOUBLE)::DECIMAL(38,12), 4)::DOUBLE AS fused FROM v_detections GROUP BY ALL"""),
)


def _raw_messages(s, sf):
    return raw_messages(table(s, sf, "documents", spread=True))


def raw_messages(docs):
    """Whole documents as message bodies behind a header template."""
    header = F.format_string(
        "Return-Path: <bounce@%s.example.org>\nReceived: from a (a [10.0.0.5])\n by mx; Tue, 14 Jul 2026 09:12:04 +0000\n"
        "Received: from b (b [8.8.4.4])\n by a; Tue, 14 Jul 2026 09:11:00 +0000\n"
        "Authentication-Results: mx; spf=pass; dkim=fail header.d=%s.example.org; dmarc=none\n"
        "From: \"Desk %s\" <desk@mail.%s.example.org>\nSubject: Report %d\nMIME-Version: 1.0\n"
        "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n",
        "source", "source", "source", "source", "doc_id",
    )
    return docs.select(F.col("doc_id").alias("msg_id"), F.concat(header, F.base64(F.encode("text", "utf-8"))).cast("binary").alias("raw"))


def _parse_at_scale(s, sf):
    signals = em.message_signals(ms.parse_messages(_raw_messages(s, sf)))
    return signals.select(
        "msg_id", "from_display", "from_domain", "subject", "spf", "dkim", "dmarc", "dkim_domain", "dkim_aligned", "hop_count",
        "private_ip_hops", "max_hop_gap_seconds", F.sha2("plain", 256).alias("sha256"),
    )


_register(
    "e01_f14_f16_parse_messages",
    _parse_at_scale,
    """SELECT doc_id AS msg_id, 'Desk ' || source AS from_display, 'example.org' AS from_domain, 'Report ' || doc_id AS subject, 'pass' AS spf, 'fail' AS dkim,
 'none' AS dmarc, source || '.example.org' AS dkim_domain, true AS dkim_aligned, 2 AS hop_count, 1 AS private_ip_hops, 64.0::DOUBLE AS max_hop_gap_seconds,
 sha256(text) AS sha256 FROM documents""",
)


def _explained(s, sf):
    """The numbers and the code the note names."""
    notes = em.explain(em.email_risk(_signals(s, sf)))
    number = lambda pattern: F.coalesce(F.regexp_extract("explanation", pattern, 1).try_cast("int"), F.lit(0))
    return notes.select(
        "msg_id", number("^([0-9]+) indicator").alias("found"), number("([0-9]+) of high severity").alias("severe"),
        F.regexp_extract("explanation", "Strongest: ([A-Z_]+) ", 1).alias("strongest"))


_register(
    "e06_explain",
    _explained,
    with_views(["v_email", "v_email_parsed"], f"""
, i AS (SELECT msg_id, {_LIST} AS l FROM s),
u AS (SELECT msg_id, unnest(l) AS r, unnest(range(len(l))) AS pos FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY (r.severity IN ('high', 'critical')) DESC, r.weight DESC, pos) AS rn FROM u),
g AS (SELECT msg_id, any_value(r.code) FILTER (WHERE rn = 1) AS strongest FROM o GROUP BY 1)
SELECT i.msg_id, len(l)::INT AS found, len(list_filter(l, lambda r: r.severity IN ('high', 'critical')))::INT AS severe, coalesce(strongest, '') AS strongest
FROM i LEFT JOIN g ON g.msg_id = i.msg_id""", _BASE),
)


def _base64url(s, sf):
    raw = _raw_messages(s, sf)
    coded = raw.select("msg_id", F.regexp_replace(F.translate(F.base64("raw"), "+/", "-_"), "[=\r\n]", "").alias("coded"), F.sha2("raw", 256).alias("want"))
    return coded.select("msg_id", (F.sha2(ms.decode_base64url(F.col("coded")), 256) == F.col("want")).alias("same"))


_register("f32_base64url", _base64url, "SELECT doc_id AS msg_id, true AS same FROM documents")


def _risked(s, sf):
    return em.email_risk(_signals(s, sf)).withColumns(
        {"message_id": F.col("msg_id").cast("string"), "from_addr": F.lit("x@y.z"), "reply_to_addr": F.lit(None).cast("string"),
         "return_path": F.lit(None).cast("string"), "dkim_domain": F.lit(None).cast("string"), "tenant_id": F.lit(1)})


def _analysis_rows(rows):
    return rows.select("message_id", "from_domain", "spf", "dkim", "dmarc", "risk_score", "verdict", F.get_json_object("features", "$.url_count").cast("int").alias("url_count"))


_register(
    "s07_email_analysis_rows",
    lambda s, sf: _analysis_rows(sinks.email_analysis_rows(_risked(s, sf))),
    with_views(["v_email", "v_email_parsed"], f"""
, i AS (SELECT *, {_LIST} AS l FROM s),
r AS (SELECT *, round(least({_FUSED}, 0.99::DOUBLE)::DECIMAL(38,12), 4)::DOUBLE AS risk_score FROM i)
SELECT msg_id::VARCHAR AS message_id, from_domain, spf, dkim, CASE WHEN dmarc IN {fv.DMARC_VALUES} THEN dmarc END AS dmarc, risk_score,
 CASE WHEN risk_score >= 0.85 THEN 'phishing' WHEN risk_score >= 0.55 THEN 'suspicious' WHEN risk_score >= 0.25 THEN 'low_confidence' ELSE 'benign' END AS verdict,
 (ip_link::INT + short_link::INT) AS url_count FROM r""", _BASE),
)


def _stored_analyses(s, sf):
    """The analyses by way of the stored table: the odd messages, all messages, the odd ones again."""
    folder, rows = scratch_path(s, "analyses"), _risked(s, sf)
    odd = rows.filter("msg_id % 2 = 1")
    for batch, part in (("odd", odd), ("all", rows), ("odd", odd)):
        sinks.write_email_analyses(part, folder, batch)
    return _analysis_rows(stored(s, folder))


_register("s07_analyses_stored", _stored_analyses, ORACLES["s07_email_analysis_rows"])
