"""Registered scalar and text queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import domains as dm
from tidewatch.functions import fixed_values as fv
from tidewatch.functions import scoring as sc
from tidewatch.functions import text as tx
from tidewatch.functions import urls as ul
from tidewatch.operators import dashboards as d
from tidewatch.operators import email as em
from tidewatch.plans import oracle_sql as osql
from tidewatch.plans.standins import AS_OF, table, view, with_views

QUERIES = {}
ORACLES = {}


def _register(key, fn, sql=None):
    QUERIES[key] = fn
    if sql is not None:
        ORACLES[key] = sql


def _dec(expr: str, digits: int) -> str:
    return f"round(({expr})::DECIMAL(38,12), {digits})::DOUBLE"


def _texts(s, sf):
    """Documents and conversation turns as one text table."""
    docs = table(s, sf, "documents", spread=True).select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = table(s, sf, "conversations", spread=True).select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return docs.unionByName(turns)


TEXTS_CTE = {
    "texts": "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations"
}

# --- F1-F5 ---------------------------------------------------------------------

_register(
    "f01_f03_hour_buckets",
    lambda s, sf: view(s, sf, "v_detections")
    .groupBy("tenant_id")
    .agg(F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi"))
    .select("tenant_id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("bucket"))
    .select("tenant_id", "bucket", (F.col("bucket") + F.make_interval(hours=F.lit(6))).alias("later")),
    with_views(["v_detections"], """
, b AS (SELECT tenant_id, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM v_detections GROUP BY 1),
s AS (SELECT tenant_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS bucket FROM b)
SELECT tenant_id, bucket, bucket + INTERVAL 6 HOURS AS later FROM s"""),
)
_register(
    "f05_url_domain",
    lambda s, sf: table(s, sf, "pages").select(
        "page_id",
        F.split_part(F.regexp_replace("url", r"^https?://(www\.)?", ""), F.lit("/"), F.lit(1)).alias("by_split"),
        F.regexp_extract("url", r"://(?:www\.)?([^/]+)", 1).alias("by_pattern"),
        F.left("html", F.lit(200)).alias("head"),
    ),
    """SELECT page_id, split_part(regexp_replace(url, '^https?://(www\\.)?', ''), '/', 1) AS by_split,
 regexp_extract(url, '://(?:www\\.)?([^/]+)', 1) AS by_pattern, left(html, 200) AS head FROM pages""",
)

# --- F6-F9 ---------------------------------------------------------------------


def _hosts(s, sf):
    pages = table(s, sf, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"))
    mail = view(s, sf, "v_email").filter("from_host IS NOT NULL").select(F.col("from_host").alias("host"))
    look = mail.select(F.concat(F.lit("www.p"), F.translate("host", "aeo", "аεо")).alias("host"))
    return pages.unionByName(mail).unionByName(look)


def _domains(s, sf):
    # Each distinct host is scored once and joined back by its own group.
    hosts = _hosts(s, sf).groupBy("host").agg(F.count("*").alias("n"))
    scored = hosts.withColumns({"registrable": dm.registrable_domain(F.col("host")), "label": dm.host_label(F.col("host"))})
    keyed = scored.withColumn("key", dm.brand_key(F.col("label")))
    folded = dm.fold_confusables(F.col("host"))
    return keyed.select(
        "host", "n", "registrable",
        dm.brand_name(F.col("key"), F.col("label")).alias("brand"),
        dm.brand_distance(F.col("key"), F.col("label")).alias("distance"),
        folded.alias("folded"), (folded != F.col("host")).alias("changed"),
    )


_HOSTS_CTE = {
    "hosts": """SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages
 UNION ALL SELECT from_host FROM v_email WHERE from_host IS NOT NULL
 UNION ALL SELECT 'www.p' || translate(from_host, 'aeo', 'аεо') FROM v_email WHERE from_host IS NOT NULL"""
}
_register(
    "f06_f09_domains",
    _domains,
    with_views(["v_email"], f"""
, g AS (SELECT host, count(*) AS n, {osql.registrable('host')} AS registrable FROM hosts GROUP BY host),
k AS (SELECT *, string_split(registrable, '.')[1] AS label FROM g),
b AS (SELECT *, {osql.brand_hit('label')} AS key FROM k)
SELECT host, n, registrable,
 CASE WHEN key // 64 BETWEEN 1 AND 2 AND length(label) >= 4 THEN {osql.str_list(fv.BRANDS)}[key % 64 + 1] END AS brand,
 CASE WHEN key // 64 BETWEEN 1 AND 2 AND length(label) >= 4 THEN (key // 64)::INT END AS distance,
 translate(host, '{fv.CONFUSABLE_LETTERS}', '{fv.CONFUSABLE_TARGETS}') AS folded,
 translate(host, '{fv.CONFUSABLE_LETTERS}', '{fv.CONFUSABLE_TARGETS}') <> host AS changed FROM b""", _HOSTS_CTE),
)

# --- F10-F12, E2 ----------------------------------------------------------------


def url_findings(df, id_col, plain, html):
    """One row per (id, link)."""
    return sc.explode_rows(df, [id_col], ul.link_findings(plain, html), "pos").select(id_col, "pos", "item.*")


def findings_sql(source, id_col, name):
    """The findings of ``source`` (id, html) as CTEs, the last one called ``name``."""
    chain, last = _findings_oracle(source, id_col).rsplit("\nSELECT ", 1)
    return f"{chain},\n{name} AS (SELECT {last})"


def _findings_oracle(source, id_col):
    anchor = fv.PATTERN_ANCHOR.replace("(?is)", "").replace("'", "''")
    plain = fv.PATTERN_PLAIN_URL.replace("(?i)", "").replace(r"\s", tx.SPACE.strip("[]")).replace("'", "''")
    token = fv.PATTERN_DOMAIN_TOKEN.replace("(?i)", "")
    return f"""
, raw AS (SELECT {id_col}, regexp_extract_all(html, '{anchor}', 1, 'is') AS hrefs, regexp_extract_all(html, '{anchor}', 2, 'is') AS labels,
   regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{plain}', 0, 'i') AS bare FROM {source}),
e AS (SELECT {id_col}, unnest(list_concat(
   list_transform(range(1, len(hrefs) + 1), lambda i: {{'pos': i, 'url': url_decode(hrefs[i]), 'anchor': labels[i]}}),
   list_transform(range(1, len(bare) + 1), lambda i: {{'pos': 10000000 + i, 'url': bare[i], 'anchor': NULL}}))) AS x FROM raw),
t AS (SELECT {id_col}, x.pos AS pos, x.anchor AS anchor, regexp_replace(trim(x.url), '[.,;)]+$', '') AS url FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY {id_col}, url ORDER BY pos) AS rn FROM t WHERE url <> ''),
n AS (SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc FROM f WHERE rn = 1),
h AS (SELECT *, lower(string_split(regexp_replace(netloc, '^.*@', ''), ':')[1]) AS host FROM n),
r AS (SELECT *, {osql.registrable('host')} AS reg, regexp_matches(host, '^([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}$') AS is_ip,
   translate(host, '{fv.CONFUSABLE_LETTERS}', '{fv.CONFUSABLE_TARGETS}') AS folded,
   regexp_extract(regexp_replace(anchor, '<[^>]+>', '', 'g'), '{token}', 1, 'i') AS token FROM h WHERE host <> ''),
k AS (SELECT *, string_split(reg, '.')[1] AS label, CASE WHEN is_ip THEN host ELSE reg END AS domain FROM r),
b AS (SELECT *, CASE WHEN NOT is_ip AND length(label) >= 4 THEN {osql.brand_hit('label')} END AS key FROM k)
SELECT {id_col}, (row_number() OVER (PARTITION BY {id_col} ORDER BY pos) - 1)::INT AS pos, url, domain, anchor AS anchor_text,
 coalesce(token <> '' AND {osql.registrable('token')} <> domain, false) AS anchor_mismatch,
 (starts_with(host, 'xn--') OR contains(host, '.xn--')) AS is_punycode,
 CASE WHEN folded <> host THEN {osql.registrable('folded')} END AS homograph_of,
 CASE WHEN key // 64 BETWEEN 1 AND 2 THEN {osql.str_list(fv.BRANDS)}[key % 64 + 1] END AS lookalike_brand,
 CASE WHEN key // 64 BETWEEN 1 AND 2 THEN (key // 64)::INT END AS lookalike_distance,
 reg IN {osql.str_tuple(fv.SHORTENERS)} AS is_shortener, is_ip AS is_ip_literal, contains(netloc, '@') AS has_credentials,
 greatest(0, length(host) - length(replace(host, '.', '')) - 1)::INT AS subdomain_depth FROM b"""


_register(
    "e02_url_findings",
    lambda s, sf: url_findings(view(s, sf, "v_html", spread=True), "page_id", F.lit(""), F.col("html")),
    with_views(["v_html"], _findings_oracle("v_html", "page_id")),
)

# --- F13, F17, F18 ----------------------------------------------------------------

_register(
    "f13_lexicon_hits",
    lambda s, sf: _texts(s, sf).withColumn("low", F.lower("text")).select(
        "id", *[tx.phrase_hits(F.col("low"), p).alias(c) for c, p in fv.PRESSURE_PHRASES.items()]),
    with_views([], "SELECT id, " + ", ".join(f"{osql.hits('lower(text)', p)}::INT AS {c}" for c, p in fv.PRESSURE_PHRASES.items()) + " FROM texts", TEXTS_CTE),
)
_register(
    "f15_private_ip",
    lambda s, sf: view(s, sf, "v_flow").select(
        "flow_id", dm.is_private_ipv4(F.col("src_ip")).alias("src_private"), dm.is_private_ipv4(F.col("dst_ip")).alias("dst_private"),
        dm.is_ip_literal(F.col("dst_ip")).alias("dst_literal")),
    with_views(["v_flow"], """
SELECT flow_id, starts_with(src_ip, '10.') AS src_private, false AS dst_private,
 list_bool_and(list_transform(string_split(dst_ip, '.'), lambda o: o::INT BETWEEN 0 AND 255)) AS dst_literal FROM v_flow"""),
)
_register(
    "f17_body_text",
    lambda s, sf: table(s, sf, "pages", spread=True).withColumn("body", tx.body_text(F.lit(""), F.col("html"))).select(
        "page_id", F.length("body").alias("n_chars"), tx.body_sha256(F.col("body")).alias("sha256")),
    f"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{tx.SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS body FROM pages)
SELECT page_id, length(body)::INT AS n_chars, CASE WHEN body <> '' THEN sha256(body) END AS sha256 FROM b""",
)
_register(
    "f18_tokens",
    lambda s, sf: _texts(s, sf).withColumn("tokens", tx.tokens(F.col("text"))).select(
        "id", F.size("tokens").alias("n_tokens"), F.md5(F.concat_ws(" ", "tokens")).alias("digest")),
    with_views([], f", t AS (SELECT id, {osql.tokens('text')} AS tokens FROM texts) "
               "SELECT id, len(tokens)::INT AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM t", TEXTS_CTE),
)

# --- F19-F23 ----------------------------------------------------------------------


def _turn_pairs(s, sf):
    turns = table(s, sf, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("tokens"))
    nxt = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tokens").alias("reply"))
    judged = turns.join(nxt, ["conv_id", "turn"]).withColumn("s", tx.stance(F.col("tokens"), F.col("reply")))
    return judged.select("conv_id", "turn", "s.stance", sc.stable_round(F.col("s.score"), 6).alias("score"))


def stance_sql(c: str, e: str) -> tuple[str, str]:
    """(stance, score) SQL of two token lists."""
    neg = osql.str_list(fv.NEGATIONS)
    overlap = f"(len(list_intersect(list_distinct({c}), {e}))::DOUBLE / len(list_distinct({c})))"
    empty = f"(len({c}) = 0 OR len({e}) = 0)"
    flipped = f"(list_has_any({c}, {neg}) <> list_has_any({e}, {neg}))"
    return (
        f"CASE WHEN {empty} OR {overlap} < 0.25 THEN 'neutral' WHEN {flipped} THEN 'contradict' ELSE 'entail' END",
        f"CASE WHEN {empty} THEN 0.5::DOUBLE WHEN {overlap} < 0.25 THEN 0.5::DOUBLE + 0.3::DOUBLE * (1 - {overlap}) "
        f"ELSE least(0.5::DOUBLE + {overlap} * 0.45::DOUBLE, 0.95::DOUBLE) END",
    )


_st, _sc = stance_sql("a.tokens", "b.tokens")
_register(
    "f19_stance",
    _turn_pairs,
    f"""
WITH t AS (SELECT conv_id, turn, {osql.tokens('text')} AS tokens FROM conversations)
SELECT a.conv_id, a.turn, {_st} AS stance, {_dec(_sc, 6)} AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
)
_GAP = f"([.!?]){tx.SPACE}+"
def sentences_sql(text: str) -> str:
    return (
        "list_filter(list_transform(string_split(regexp_replace(" + text + ", '" + _GAP + "', '\\1\ue000', 'g'), '\ue000'), "
        "lambda s: regexp_replace(s, '^" + tx.SPACE + "+|" + tx.SPACE + "+$', '', 'g')), lambda s: length(s) > 40)"
    )


_register(
    "f20_sentences",
    lambda s, sf: sc.explode_rows(table(s, sf, "documents", spread=True), ["doc_id"], tx.sentences(F.col("text")), "pos").withColumnRenamed("item", "sentence"),
    f"""
WITH t AS (SELECT doc_id, {sentences_sql('text')} AS ss FROM documents)
SELECT doc_id, unnest(range(0, len(ss)))::INT AS pos, unnest(ss) AS sentence FROM t""",
)
_register(
    "f21_summary_line",
    lambda s, sf: _texts(s, sf).select("id", tx.summary_line(F.col("text")).alias("summary")),
    with_views([], f"""
, l AS (SELECT id, replace(regexp_replace(text, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g'), chr(10), ' ') AS line FROM texts)
SELECT id, CASE WHEN length(line) > 280 THEN left(line, 280) || '…' ELSE line END AS summary FROM l""", TEXTS_CTE),
)
RATING_SQL = """CASE WHEN contains(lower(rating),'pants on fire') OR contains(lower(rating),'fabricated')
   OR (contains(lower(rating),'false') AND NOT contains(lower(rating),'mostly true') AND NOT contains(lower(rating),'not false')) THEN 12
 WHEN {partly} > 0 THEN 40 WHEN {true} > 0 OR trim(lower(rating)) = 'true' THEN 85 WHEN {open} > 0 THEN 50 ELSE 45 END""".format(
    partly=osql.hits("lower(rating)", fv.RATING_PARTLY), true=osql.hits("lower(rating)", fv.RATING_TRUE), open=osql.hits("lower(rating)", fv.RATING_OPEN)
)
_register(
    "f22_rating_score",
    lambda s, sf: view(s, sf, "v_reviews").select("review_id", "rating", tx.rating_score(F.col("rating")).alias("score")),
    with_views(["v_reviews"], f"SELECT review_id, rating, {RATING_SQL} AS score FROM v_reviews"),
)


def style_rows(df, id_col):
    signals = df.select(id_col, *[c.alias(n) for n, c in tx.writing_style(F.col("text")).items()])
    scored = signals.withColumn("score", tx.style_score({c: F.col(c) for c in signals.columns if c != id_col}))
    return scored.withColumn("shouting", F.coalesce("shouting", F.lit(False))).withColumn("verdict", tx.style_verdict(F.col("score")))


def style_sql(source: str, id_col: str) -> str:
    """CTE chain ending in ``styled``: the signals, score and verdict."""
    low = "lower(text)"
    return f"""
, sig AS (SELECT {id_col}, {osql.hits(low, fv.SENSATIONAL)} AS sensational, {osql.hits(low, fv.CONSPIRACY)} AS conspiracy,
   {osql.hits(low, fv.DEATH_RUMOUR)} > 0 AS death_rumour, {osql.hits(low, fv.SOURCING)} AS sourcing,
   (length(text) - length(replace(text, '!', '')))::INT AS exclamations,
   coalesce(length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) > 20 AND
     length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g'))::DOUBLE / nullif(length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')), 0) > 0.3, false) AS shouting,
   regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])(19|20)\\p{{Nd}}{{2}}($|[^\\p{{L}}\\p{{N}}_])')
     OR regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])\\p{{Nd}}+(\\.\\p{{Nd}}+)?%[\\p{{L}}\\p{{N}}_]') AS figures FROM {source}),
sco AS (SELECT *, greatest(5, least(90, 55 - least(30, sensational * 10) - least(38, conspiracy * 19) - CASE WHEN death_rumour THEN 16 ELSE 0 END
   + least(24, sourcing * 8) - CASE WHEN exclamations >= 2 THEN least(15, exclamations * 4) ELSE 0 END
   - CASE WHEN shouting THEN 12 ELSE 0 END + CASE WHEN figures THEN 6 ELSE 0 END))::INT AS score FROM sig),
styled AS (SELECT *, CASE WHEN score < 25 THEN 'Fake News' WHEN score < 40 THEN 'Misleading' WHEN score >= 65 THEN 'Credible' ELSE 'Unverified' END AS verdict FROM sco)"""


_register(
    "f23_writing_style",
    lambda s, sf: style_rows(_texts(s, sf), "id"),
    with_views([], style_sql("texts", "id") + " SELECT * FROM styled", TEXTS_CTE),
)

# --- F28, F30, F33, W4 -------------------------------------------------------------

_register(
    "f30_event_payload",
    # Build the payload, spoil every payload of one module, parse it back and drop what does not parse.
    lambda s, sf: _payload_round_trip(view(s, sf, "v_detections")),
    with_views(["v_detections"], """
SELECT 'detection' AS event, id, tenant_id, module, threat_type, risk_score, ref_id, left(coalesce(summary,''),200) AS summary, ts
FROM v_detections WHERE module <> 'news'"""),
)


def _payload_round_trip(detections):
    from tidewatch.streaming import events as ev

    payloads = ev.detection_payload(detections)
    spoiled = payloads.withColumn("value", F.when(F.get_json_object("value", "$.module") == "news", F.expr("left(value, 20)")).otherwise(F.col("value")))
    return ev.parse_payload(spoiled)


_register(
    "f33_attachment_class",
    lambda s, sf: view(s, sf, "v_email_parsed").select(
        "id",
        F.coalesce(F.col("attachment_ext").isin(*fv.EXECUTABLE_EXTENSIONS), F.lit(False)).alias("dangerous"),
        F.coalesce(F.col("attachment_ext").isin(*fv.MACRO_EXTENSIONS), F.lit(False)).alias("macro"),
    ),
    with_views(["v_email_parsed"], f"""
SELECT id, coalesce(attachment_ext IN {fv.EXECUTABLE_EXTENSIONS}, false) AS dangerous, coalesce(attachment_ext IN {fv.MACRO_EXTENSIONS}, false) AS macro FROM v_email_parsed"""),
)
_register(
    "w04_hop_gaps",
    lambda s, sf: table(s, sf, "events").select(
        "event_id", em.max_gap(F.array(F.col("value") * 3, F.col("value"), F.col("value") + F.col("user_id"), F.lit(7.0))).alias("gap")
    ).withColumn("gap", sc.stable_round(F.col("gap"), 6)),
    f"""
WITH t AS (SELECT event_id, list_sort([value * 3, value, value + user_id, 7.0::DOUBLE]) AS l FROM events)
SELECT event_id, {_dec('greatest(l[2] - l[1], l[3] - l[2], l[4] - l[3])', 6)} AS gap FROM t""",
)

# --- J2, J6, S4 ---------------------------------------------------------------------

_register(
    "j02_s04_corpus",
    lambda s, sf: _corpus(s, sf),
    with_views(["v_corpus", "v_sources"], """
SELECT d.doc_id, d.url, s.domain AS source_domain, coalesce(s.credibility_weight, 0.5) AS credibility, length(d.text)::INT AS n_text
FROM v_corpus d LEFT JOIN v_sources s ON s.domain = split_part(regexp_replace(d.url, '^https?://(www\\.)?', ''), '/', 1)"""),
)


def _corpus(s, sf):
    from tidewatch.sources.corpus import read_corpus

    docs = view(s, sf, "v_corpus").withColumn("kind", F.lit("evidence")).withColumn("ingested_at", F.lit(AS_OF).cast("timestamp"))
    return read_corpus(docs, view(s, sf, "v_sources")).select("doc_id", "url", "source_domain", "credibility", F.length("text").alias("n_text"))
