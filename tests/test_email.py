"""Golden messages through the whole e-mail job."""

import base64

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import domains as dm
from tidewatch.functions import fixed_values as fv
from tidewatch.functions import urls as ul
from tidewatch.operators import email as em
from tidewatch.sources import messages as ms
from tidewatch.sources import sinks

CLEAN = """Return-Path: <news@shop.example.com>
Received: from out.shop.example.com (out [198.51.99.7])
 by mx.home.example.net; Mon, 03 Jun 2024 10:00:30 +0000
Received: from app (app [10.1.2.3]) by out.shop.example.com; Mon, 03 Jun 2024 10:00:00 +0000
Authentication-Results: mx.home.example.net; spf=pass; dkim=pass header.d=shop.example.com; dmarc=pass
From: Shop <news@shop.example.com>
To: me@home.example.net
Subject: Your parcel
Message-ID: <1@shop.example.com>
Content-Type: text/plain; charset=utf-8

Parcel 7 is on its way, see https://shop.example.com/p/7.
"""

BAIT = """Return-Path: <b@sender-farm.ru>
Received: from x (10.9.8.7) by mx.home.example.net; Mon, 03 Jun 2024 03:00:00 +0000
Authentication-Results: mx.home.example.net; spf=fail; dkim=fail header.d=sender-farm.ru; dmarc=fail
From: "Paypal Help" <help@paypa1.com>
Reply-To: desk@protonmail.com
To: me@home.example.net
Subject: URGENT: account suspended
Content-Type: text/html; charset=utf-8

<p>Please verify your account immediately.</p>
<a href="http://203.0.113.9/in">https://www.paypal.com</a> <a href="https://bit.ly/q1">go</a>
"""

CYRILLIC = """Authentication-Results: mx; spf=pass; dkim=pass header.d=paypa1.com
From: Service <s@paypa1.com>
To: u@home.example.net
Subject: Hello
Content-Type: text/html

<a href="https://раypal.com/verify">open</a>
"""

BARE = "From: A <a@home.example.net>\nTo: b@home.example.net\nSubject: Lunch?\n\nAt one?\n"

PARTS = """From: Bill <bill@gmail.com>
To: x@y.example
Subject: =?utf-8?q?Rechnung_f=C3=BCr_Mai?=
DKIM-Signature: v=1; a=rsa-sha256; d=gmail.com; s=k
Received-SPF: softfail (whatever)
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=b1

--b1
Content-Type: text/plain

plain \xe9
--b1
Content-Type: application/octet-stream
Content-Disposition: attachment; filename="run.EXE"
Content-Transfer-Encoding: base64

QUJD
--b1
Content-Type: application/vnd.ms-word
Content-Disposition: attachment; filename="sheet.docm"

x
--b1--
"""
JUNK = ["", "words only", "From: \nSubject:\n\n", "\x00\x01"]


@pytest.fixture(scope="module")
def scored(spark):
    raw = {"clean": CLEAN, "bait": BAIT, "cyrillic": CYRILLIC, "bare": BARE, **{f"junk{i}": j for i, j in enumerate(JUNK)}}
    rows = [(k, bytearray(v.encode())) for k, v in raw.items()] + [("parts", bytearray(PARTS.encode("latin-1")))]
    messages = spark.createDataFrame(rows, "msg_id string, raw binary")
    out = em.score_messages(messages)
    return {r["msg_id"]: r for r in out.collect()}


def codes(row):
    return {i["code"] for i in row["indicators"]}


def test_clean_message(scored):
    r = scored["clean"]
    assert (r["from_domain"], r["spf"], r["dkim"], r["dmarc"], r["dkim_aligned"]) == ("example.com", "pass", "pass", "pass", True)
    assert r["risk_score"] < 0.15 and r["verdict"] == "benign"
    assert r["hop_count"] == 2 and r["private_ip_hops"] == 1 and r["max_hop_gap_seconds"] == 30.0
    assert [u["url"] for u in r["urls"]] == ["https://shop.example.com/p/7"]


def test_bait_message(scored):
    r = scored["bait"]
    assert {
        "SPF_FAIL", "DKIM_FAIL", "DMARC_FAIL", "DKIM_MISALIGNED", "REPLY_TO_MISMATCH", "LOOKALIKE_SENDER_DOMAIN",
        "URL_ANCHOR_MISMATCH", "URL_IP_LITERAL", "URL_SHORTENER", "PRESSURE_LANGUAGE", "CREDENTIAL_HARVEST_PATTERN", "RETURN_PATH_MISMATCH",
    } <= codes(r)
    assert r["risk_score"] > 0.9 and r["verdict"] == "phishing" and r["dkim_aligned"] is False
    assert r["explanation"].startswith(f"{len(r['indicators'])} indicator(s)")


def test_look_alike_letters_without_charset(scored):
    r = scored["cyrillic"]
    assert {"URL_HOMOGRAPH", "LOOKALIKE_SENDER_DOMAIN"} <= codes(r)
    assert [u["homograph_of"] for u in r["urls"]] == ["paypal.com"]


def test_missing_authentication_is_not_a_verdict(scored):
    assert codes(scored["bare"]) == {"NO_AUTH_RESULTS"} and scored["bare"]["risk_score"] < 0.15


def test_junk_is_scored_too(scored):
    for i in range(len(JUNK)):
        assert 0 <= scored[f"junk{i}"]["risk_score"] <= 1


def test_parts_and_fallback_headers(scored):
    r = scored["parts"]
    assert r["subject"] == "Rechnung für Mai" and r["plain"] == "plain é"
    assert [(a["extension"], a["size"]) for a in r["attachments"]] == [("exe", 3), ("docm", 1)]
    assert r["spf"] == "softfail" and r["dkim_domain"] == "gmail.com"
    assert {"DANGEROUS_ATTACHMENT", "MACRO_ATTACHMENT"} <= codes(r)


def test_feature_row_is_numeric_and_ordered(spark):
    signals = em.message_signals(ms.parse_messages(spark.createDataFrame([("a", bytearray(BAIT.encode()))], "msg_id string, raw binary")))
    features = em.email_features(signals)
    assert tuple(features.columns[1:]) == fv.EMAIL_FEATURES
    row = features.first()
    assert all(isinstance(row[c], (int, float)) for c in fv.EMAIL_FEATURES)
    assert row["spf_fail"] == 1 and row["url_count"] == 3 and row["url_ip_literals"] == 1 and row["lexicon_hits"] >= 3


def test_model_score_takes_over(spark):
    signals = em.message_signals(ms.parse_messages(spark.createDataFrame([("a", bytearray(BARE.encode()))], "msg_id string, raw binary")))
    r = em.email_risk(signals, F.lit(0.91), "m1").first()
    assert (r["risk_score"], r["verdict"], r["score_source"], r["model_version"]) == (0.91, "phishing", "model", "m1")


def test_broken_message_keeps_its_reason(spark, tmp_path):
    for name in ("a.eml", "sub/b.eml"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(CLEAN.encode())
    found = ms.read_messages(spark, str(tmp_path))
    assert found.count() == 2
    assert ms.parse_report(ms.parse_messages(found)).first().asDict() == {"parsed": 2, "skipped": 0}


def test_analysis_rows(spark):
    signals = em.message_signals(ms.parse_messages(spark.createDataFrame([("a", bytearray(BAIT.encode()))], "msg_id string, raw binary")))
    rows = sinks.email_analysis_rows(em.email_risk(signals).withColumn("tenant_id", F.lit(1)))
    assert tuple(rows.columns) == sinks.ANALYSIS_COLUMNS
    assert rows.select(F.get_json_object("indicators", "$[0].code")).first()[0] == "SPF_FAIL"


def test_base64url(spark):
    coded = base64.urlsafe_b64encode(CLEAN.encode()).decode().rstrip("=")
    df = spark.createDataFrame([(coded,), ("%%%",)], "c string")
    got = [r[0] for r in df.select(ms.decode_base64url(F.col("c"))).collect()]
    assert bytes(got[0]) == CLEAN.encode() and got[1] is None


@pytest.mark.parametrize("host,want", [("mail.google.com", "google.com"), ("a.b.co.uk", "b.co.uk"), ("example.com", "example.com"), ("", ""), (".X.Y.Z.", "y.z"), ("co.uk", "co.uk")])
def test_registrable_domain(spark, host, want):
    assert spark.range(1).select(dm.registrable_domain(F.lit(host))).first()[0] == want


@pytest.mark.parametrize("host,want", [("microsoft.com", None), ("micros0ft.com", "microsoft"), ("paypa1.com", "paypal"), ("ups1.com", "ups"), ("up.com", None), ("xyzzyq.com", None)])
def test_nearest_brand(spark, host, want):
    label = dm.host_label(F.lit(host))
    assert spark.range(1).select(dm.brand_name(dm.brand_key(label), label)).first()[0] == want


@pytest.mark.parametrize("ip,want", [("10.0.0.1", True), ("172.31.1.1", True), ("172.32.1.1", False), ("8.8.8.8", False), ("127.0.0.1", True), ("169.254.9.9", True), ("198.18.0.1", True), ("203.0.113.5", True), ("192.0.0.9", False), ("240.0.0.1", True), ("999.1.1.1", False)])
def test_private_addresses(spark, ip, want):
    assert spark.range(1).select(dm.is_private_ipv4(F.lit(ip))).first()[0] is want


@pytest.mark.parametrize("host,want", [("1.2.3.4", True), ("01.2.3.4", False), ("::1", True), ("2001:db8::7", True), ("a.b", False), ("[::1]", True), ("1::2::3", False)])
def test_ip_literals(spark, host, want):
    assert spark.range(1).select(dm.is_ip_literal(F.lit(host))).first()[0] is want


def test_link_details(spark):
    html = (
        '<a HREF="https://User:pw@Evil.Example.com:8080/p%20q?x#y">Go to <b>bank.com</b></a> <a href="/local">x</a>'
        "<a href='https://xn--pypal-4ve.com'>a</a> https://a.b.c.d.e.example.org/deep. <a href=\"https://t.co/1+2%zz\">s</a>"
    )
    df = spark.createDataFrame([("see (https://t.co/1) and https://t.co/1", html)], "plain string, html string")
    urls = df.select(ul.link_findings(F.col("plain"), F.col("html")).alias("u")).first()["u"]
    assert [u["url"] for u in urls] == [
        "https://User:pw@Evil.Example.com:8080/p q?x#y", "https://xn--pypal-4ve.com", "https://t.co/1+2%zz", "https://t.co/1", "https://a.b.c.d.e.example.org/deep"]
    first, puny, broken, short, deep = urls
    assert first["domain"] == "example.com" and first["has_credentials"] and first["anchor_mismatch"]
    assert puny["is_punycode"] and short["is_shortener"] and broken["is_shortener"] and deep["subdomain_depth"] == 5
