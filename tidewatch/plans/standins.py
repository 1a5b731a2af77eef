"""Stand-in views: the job inputs, shaped out of the plain test tables.

Each text runs unchanged on Spark SQL and on DuckDB, so a query and its oracle
read the same rows.  ``{table}`` names a test table or another stand-in.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import prepare, spread_small_scan

AS_OF = "2024-01-31 00:00:00"

VIEWS = {
    "v_detections": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, user_id % 5 AS tenant_id,
               CASE WHEN event_type IN ('click','view') THEN 'email'
                    WHEN event_type = 'signup' THEN 'news' ELSE 'network' END AS module,
               event_type AS threat_type, least(value / 200.0, CAST(1 AS DOUBLE)) AS risk_score,
               event_id AS ref_id, props AS summary, user_id % 3 AS model_version
        FROM {events}""",
    "v_models": """
        SELECT * FROM (VALUES (0,'email-clf','0.1.0','classification',true),
                              (1,'flow-det','0.1.0','anomaly',true),
                              (1,'flow-det','0.0.9','anomaly',false)) AS t(id,name,version,task,is_active)""",
    "v_email": """
        SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS analyzed_at, user_id % 5 AS tenant_id,
               CASE WHEN user_id % 9 = 0 THEN NULL
                    WHEN user_id % 4 = 0 THEN 'mail.micros0ft.com'
                    WHEN user_id % 4 = 1 THEN 'gmail.com'
                    ELSE concat('a.d', CAST(user_id % 20 AS STRING), '.co.uk') END AS from_host,
               CASE event_id % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'softfail' WHEN 3 THEN 'none' END AS spf,
               CASE event_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS dkim,
               CASE event_id % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'bogus' END AS dmarc,
               CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS dkim_aligned,
               least(value / 100.0, CAST(1 AS DOUBLE)) AS risk_score
        FROM {events}""",
    "v_email_parsed": """
        SELECT event_id AS id,
               CASE user_id % 6 WHEN 0 THEN 'Microsoft Support' WHEN 1 THEN 'paypal.com billing' WHEN 2 THEN NULL ELSE 'Colleague' END AS from_display,
               CASE event_id % 7 WHEN 0 THEN 'mx.protonmail.com' END AS reply_to_host,
               CASE event_id % 8 WHEN 0 THEN 'bounce.mailer.ru' WHEN 1 THEN 'gmail.com' END AS return_path_host,
               CASE event_type WHEN 'error' THEN 'URGENT: account suspended' WHEN 'click' THEN 'Re: lunch' ELSE 'Invoice' END AS subject,
               CASE event_id % 3 WHEN 0 THEN 'please verify your account at http://192.168.4.9/x now' WHEN 1 THEN '' ELSE 'refund, confidential, act now' END AS plain,
               CASE event_id % 4 WHEN 0 THEN '<p><a href="https://bit.ly/z">login.microsoftonline.com</a></p>' ELSE '' END AS html,
               CASE event_id % 10 WHEN 0 THEN 'exe' WHEN 1 THEN 'docm' END AS attachment_ext,
               event_id % 6 AS hop_count, event_id % 3 AS private_ip_hops, value AS max_hop_gap_seconds
        FROM {events}""",
    "v_incidents": """
        SELECT user_id AS id, user_id % 5 AS tenant_id, 'port_scan' AS kind,
               CASE WHEN max(value) > 300 THEN 'critical' WHEN max(value) > 200 THEN 'high'
                    WHEN max(value) > 100 THEN 'medium' ELSE 'low' END AS severity,
               CASE user_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolved' ELSE 'false_positive' END AS status,
               CAST(min(ts) AS TIMESTAMP) AS opened_at
        FROM {events} GROUP BY user_id""",
    "v_anomalies": """
        SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS incident_id, value AS score
        FROM {events} WHERE event_type = 'error'""",
    "v_forecasts": """
        SELECT user_id % 5 AS tenant_id, event_type AS series, date_trunc('day', CAST(ts AS TIMESTAMP)) AS issued_at,
               date_trunc('hour', CAST(ts AS TIMESTAMP)) AS horizon_ts,
               min(value) AS p10, avg(value) AS p50, max(value) AS p90
        FROM {events} GROUP BY 1, 2, 3, 4""",
    "v_feedback": """
        SELECT event_id AS id, CASE event_id % 2 WHEN 0 THEN 'email' ELSE 'verdict' END AS subject_kind,
               CASE WHEN event_id % 3 = 0 THEN event_id END AS used_in_training, CAST(ts AS TIMESTAMP) AS created_at
        FROM {events}""",
    "v_log": """
        SELECT event_id AS id, CAST(ts AS DATE) AS batch_key, CAST(ts AS TIMESTAMP) AS ts,
               CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('10.0.0.', CAST(user_id % 250 AS STRING)) END AS source_ip,
               CASE event_type WHEN 'error' THEN 'ICMP' WHEN 'view' THEN 'udp' ELSE 'TCP' END AS protocol,
               CAST(floor(value * 40) AS BIGINT) AS packet_size,
               CASE WHEN event_id % 97 = 0 THEN 'SYN SYN SYN' WHEN event_id % 101 = 0 THEN 'syn_flood' ELSE 'ACK' END AS flags
        FROM {events}""",
    "v_flow": """
        SELECT event_id AS flow_id, CAST(ts AS TIMESTAMP) AS ts,
               concat('10.0.0.', CAST(user_id % 250 AS STRING)) AS src_ip,
               concat('93.184.', CAST(event_id % 250 AS STRING), '.1') AS dst_ip,
               CASE event_type WHEN 'error' THEN 8443 WHEN 'view' THEN 53 ELSE 443 END AS dst_port,
               CASE event_type WHEN 'view' THEN 'udp' ELSE 'tcp' END AS protocol,
               value * 10 AS duration_ms, 1 + event_id % 40 AS fwd_packets, event_id % 60 AS bwd_packets,
               (event_id % 40) * 60 AS fwd_bytes, (event_id % 60) * 90 AS bwd_bytes,
               CASE WHEN event_type = 'error' AND value > 150 THEN 'ATTACK'
                    WHEN event_id % 13 = 0 THEN NULL ELSE 'BENIGN' END AS label,
               value AS raw_value
        FROM {events}""",
    "v_corpus": """
        SELECT doc_id, '' AS title, text, concat('https://www.', source, '.example.org/', CAST(doc_id AS STRING)) AS url,
               concat(source, '.example.org') AS domain
        FROM {documents}""",
    "v_sources": """
        SELECT DISTINCT concat(source, '.example.org') AS domain,
               CAST(substr(source, 4) AS INT) / CAST(20 AS DOUBLE) AS credibility_weight
        FROM {documents} WHERE source <> 'src19'""",
    "v_claims": """
        SELECT item_id AS claim_id, text FROM {benchmark}""",
    # Every document has reviews of three claims; those from the seventh claim on are not counted.
    "v_reviews": """
        SELECT doc_id, doc_id * 10 + 3 * c + n AS review_id, CAST(c + 2 * (doc_id % 4) AS INT) AS claim_no, concat('pub', CAST(n AS STRING)) AS publisher,
               CASE (doc_id + c + n) % 8 WHEN 0 THEN 'Pants on Fire' WHEN 1 THEN 'Mostly False' WHEN 2 THEN 'Mostly True'
                    WHEN 3 THEN 'True' WHEN 4 THEN 'Misleading' WHEN 5 THEN 'Unproven' WHEN 6 THEN 'Inaccurate' ELSE 'Satire' END AS rating,
               concat('https://pub', CAST(n AS STRING), '.example.net/', CAST(doc_id AS STRING), '/', CAST(c AS STRING)) AS url
        FROM {documents} CROSS JOIN (VALUES (0,0),(0,1),(0,2),(1,0),(1,1),(1,2),(2,0),(2,1),(2,2)) AS t(c,n)""",
    "v_html": """
        SELECT page_id, concat('<p><a href="', url, '">', CASE page_id % 3 WHEN 0 THEN 'see paypal.com' WHEN 1 THEN 'click' ELSE url END,
               '</a> also http://192.168.4.9/x, https://bit.ly/z and https://a.b.c.d.micros0ft.com/</p>', html) AS html
        FROM {pages}""",
    "v_scored": """
        SELECT doc_id, toxic AS y, ((doc_id * 7919) % 1000) / CAST(1000 AS DOUBLE) AS score FROM {labels}""",
    "v_hourly": """
        SELECT event_type AS series, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS ts, count(*) AS n
        FROM {events} GROUP BY 1, 2""",
    "v_history": """
        SELECT event_id AS id, user_id, CAST(ts AS TIMESTAMP) AS scanned_at,
               CASE event_type WHEN 'signup' THEN 'NEWS' WHEN 'purchase' THEN 'NEWS' WHEN 'click' THEN 'EMAIL' ELSE 'CYBER' END AS type,
               CASE WHEN event_type = 'signup' THEN concat(CAST(event_id % 101 AS STRING), '% Credible')
                    WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'Fake News' WHEN 1 THEN 'Misleading' ELSE ' 62% mixed' END
                    WHEN value > 120 THEN 'Critical' WHEN value > 80 THEN 'High' WHEN value > 40 THEN 'Medium'
                    WHEN value > 20 THEN 'Low' WHEN value > 10 THEN 'Suspicious' ELSE 'Safe' END AS result,
               props AS summary
        FROM {events}""",
}


def _needs(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the given parquet tables; ``spread`` is for jobs that are costly per row."""
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small_scan(df) if spread else df


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A stand-in view as a DataFrame."""
    prepare(spark)
    text = VIEWS[name]
    parts = {n: (view if n in VIEWS else table)(spark, sf_dir, n, spread) for n in _needs(text)}
    return spark.sql(text, **parts)


def with_views(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """The same views as a ``WITH`` clause in front of an oracle statement."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in ctes or name not in VIEWS:
            return
        for inner in _needs(VIEWS[name]):
            add(inner)
        ctes[name] = VIEWS[name].format(**{n: n for n in _needs(VIEWS[name])})

    for name in names:
        add(name)
    ctes.update(extra or {})
    clause = ",\n".join(f"{k} AS ({v})" for k, v in ctes.items())
    return f"WITH {clause}\n{body.strip()}"
