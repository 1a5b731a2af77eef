"""E-mail job: parsed messages -> signals -> features, indicators, one fused risk.

Everything here is native columns over the parser's output, row by row, so the
whole job is one stage after the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import domains as dm
from tidewatch.functions import fixed_values as fv
from tidewatch.functions import scoring as sc
from tidewatch.functions import text as tx
from tidewatch.functions import urls as ul

AUTH_METHODS = ("spf", "dkim", "dmarc")


def _domain_of(address: Column) -> Column:
    return F.when(address.contains("@"), dm.registrable_domain(F.substring_index(address, "@", -1)))


# --- headers ------------------------------------------------------------------


def auth_verdicts(auth_results: Column, received_spf: Column, dkim_signature: Column) -> dict[str, Column]:
    """First verdict per method over all headers, and the signing domain."""
    # ';' ends a header here: no pattern below can match across it.
    joined = F.concat_ws(";", auth_results)
    pairs = F.zip_with(
        F.regexp_extract_all(joined, F.lit(fv.PATTERN_AUTH_PAIR.replace("(?i)", "(?iU)")), 1),
        F.regexp_extract_all(joined, F.lit(fv.PATTERN_AUTH_PAIR.replace("(?i)", "(?iU)")), 2),
        lambda m, v: F.struct(F.lower(m).alias("method"), F.lower(v).alias("verdict")),
    )

    def first(method: str) -> Column:
        return F.get(F.filter(pairs, lambda p: p["method"] == method), F.lit(0))["verdict"]

    spf_tokens = F.transform(received_spf, lambda h: F.lower(F.regexp_extract(h, r"^\s*(\S+)", 1)))
    received = F.get(F.filter(spf_tokens, lambda t: t.isin(*fv.SPF_VALUES)), F.lit(0))
    signer = F.regexp_extract(joined, fv.PATTERN_SIGNER.replace("(?i)", "(?iU)"), 1)
    signature = F.regexp_extract(dkim_signature, "(?U)" + fv.PATTERN_SIGNATURE_DOMAIN, 1)
    return {
        "spf": F.coalesce(first("spf"), received),
        "dkim": first("dkim"),
        "dmarc": first("dmarc"),
        "dkim_domain": F.lower(F.coalesce(F.nullif(signer, F.lit("")), F.nullif(signature, F.lit("")))),
    }


def private_hops(received: Column) -> Column:
    ips = F.flatten(F.transform(received, lambda h: F.regexp_extract_all(h, F.lit(fv.PATTERN_IPV4), 1)))
    return F.size(F.filter(ips, dm.is_private_ipv4))


def max_gap(times: Column) -> Column:
    """Largest gap between consecutive sorted values of an array, NULL below two values."""
    gaps = sc.let(
        F.array_sort(times),
        lambda t: F.zip_with(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), lambda b, a: b - a),
    )
    return F.array_max(gaps)


def message_signals(parsed: DataFrame) -> DataFrame:
    """Parser output to the signal columns the scoring functions read."""
    auth = auth_verdicts(F.col("auth_results"), F.col("received_spf"), F.col("dkim_signature"))
    empty = F.lit("")
    return (
        parsed.withColumns(
            auth
            | {
                "plain": F.coalesce("plain", empty),
                "html": F.coalesce("html", empty),
                "attachments": F.coalesce("attachments", F.array().cast(parsed.schema["attachments"].dataType)),
                "from_domain": _domain_of(F.col("from_addr")),
                "reply_to_domain": _domain_of(F.col("reply_to_addr")),
                "return_path_domain": _domain_of(F.col("return_path")),
                "hop_count": F.coalesce(F.greatest(F.size("received"), F.lit(0)), F.lit(0)),
                "private_ip_hops": F.coalesce(F.greatest(private_hops(F.col("received")), F.lit(0)), F.lit(0)),
                "max_hop_gap_seconds": max_gap(F.col("hop_times")),
            }
        )
        .drop("auth_results", "received_spf", "received", "hop_times", "dkim_signature", "hop_time_failures")
        .transform(derive_signals)
    )


def derive_signals(df: DataFrame) -> DataFrame:
    """Second step, shared with callers that bring their own parsed columns."""
    out = df.withColumn("display", F.lower("from_display")).withColumns(
        {
            "dkim_aligned": F.when(
                (F.col("dkim_domain") != "") & (F.col("from_domain") != ""),
                dm.registrable_domain(F.col("dkim_domain")) == F.col("from_domain"),
            )
            if "dkim_domain" in df.columns
            else F.col("dkim_aligned"),
            "body_text": tx.body_text(F.col("plain"), F.col("html")),
            "urls": ul.link_findings(F.col("plain"), F.col("html")),
            "brand_key": dm.brand_key(dm.host_label(F.col("from_domain"))),
            "brand_label": dm.host_label(F.col("from_domain")),
            "display_domain": ul.claimed_domain(F.col("from_display")),
            "display_brand": F.coalesce(*[F.when(F.col("display").contains(b), F.lit(b)) for b in fv.BRANDS]),
        }
    )
    lowered = F.lower(F.concat_ws(" ", F.coalesce(F.col("subject"), F.lit("")), F.col("body_text")))
    hits = {f"hits_{c}": tx.phrase_hits(lowered, p) for c, p in fv.PRESSURE_PHRASES.items()}
    return out.withColumns(
        {
            "body_sha256": tx.body_sha256(F.col("body_text")),
            "from_brand": dm.brand_name(F.col("brand_key"), F.col("brand_label")),
            "from_brand_distance": dm.brand_distance(F.col("brand_key"), F.col("brand_label")),
        }
        | hits
    ).drop("brand_key", "brand_label", "display")


# --- features -----------------------------------------------------------------


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def _url_count(test) -> Column:
    return F.size(F.filter("urls", test))


def _differs(column: str) -> Column:
    """Both domains known and different."""
    return (F.col(column) != "") & (F.col("from_domain") != "") & (F.col(column) != F.col("from_domain"))


def _looks_imitated(u: Column) -> Column:
    return u["is_punycode"] | u["homograph_of"].isNotNull()


def _categories() -> list[Column]:
    return [F.col(f"hits_{c}") for c in fv.PRESSURE_PHRASES]


def feature_columns() -> dict[str, Column]:
    spf, dkim, dmarc = (F.col(m) for m in AUTH_METHODS)
    subject = F.coalesce(F.col("subject"), F.lit(""))
    plain_len, html_len = F.length("plain"), F.length("html")
    ext = lambda allowed: F.size(F.filter("attachments", lambda a: a["extension"].isin(*allowed)))
    by_name = {
        "spf_pass": _flag(spf == "pass"),
        "spf_fail": _flag(spf.isin("fail", "softfail")),
        "dkim_pass": _flag(dkim == "pass"),
        "dkim_fail": _flag(dkim == "fail"),
        "dmarc_pass": _flag(dmarc == "pass"),
        "dmarc_fail": _flag(dmarc == "fail"),
        "dkim_aligned": _flag(F.col("dkim_aligned")),
        "auth_present": _flag(F.coalesce(spf, dkim, dmarc).isNotNull()),
        "reply_to_mismatch": _flag(_differs("reply_to_domain")),
        "return_path_mismatch": _flag(_differs("return_path_domain")),
        "from_is_freemail": _flag(F.col("from_domain").isin(*fv.FREEMAIL)),
        "from_lookalike": _flag(F.col("from_brand").isNotNull()),
        "display_name_len": F.length(F.coalesce("from_display", F.lit(""))),
        "hop_count": F.col("hop_count"),
        "private_ip_hops": F.col("private_ip_hops"),
        "max_hop_gap_seconds": F.coalesce("max_hop_gap_seconds", F.lit(0.0)),
        "url_count": F.size("urls"),
        "url_unique_domains": F.size(F.array_distinct(F.transform("urls", lambda u: u["domain"]))),
        "url_anchor_mismatches": _url_count(lambda u: u["anchor_mismatch"]),
        "url_punycode": _url_count(_looks_imitated),
        "url_lookalikes": _url_count(lambda u: u["lookalike_brand"].isNotNull()),
        "url_shorteners": _url_count(lambda u: u["is_shortener"]),
        "url_ip_literals": _url_count(lambda u: u["is_ip_literal"]),
        "url_max_subdomain_depth": F.coalesce(F.array_max(F.transform("urls", lambda u: u["subdomain_depth"])), F.lit(0)),
        "attachment_count": F.size("attachments"),
        "dangerous_attachments": ext(fv.EXECUTABLE_EXTENSIONS),
        "macro_attachments": ext(fv.MACRO_EXTENSIONS),
        "body_length": F.length("body_text"),
        "subject_length": F.length(subject),
        "lexicon_categories": sc.total([(c > 0).cast("int") for c in _categories()]),
        "lexicon_hits": sc.total(_categories()),
        "has_html": _flag(html_len > 0),
        "html_to_text_ratio": F.when(plain_len > 0, html_len / F.nullif(plain_len, F.lit(0))).otherwise((html_len > 0).cast("double")),
        "subject_is_reply": _flag(F.lower(subject).startswith("re:") | F.lower(subject).startswith("fwd:")),
    }
    return {name: by_name[name] for name in fv.EMAIL_FEATURES}


def email_features(signals: DataFrame, id_col: str = "msg_id") -> DataFrame:
    return signals.select(id_col, *[c.alias(n) for n, c in feature_columns().items()])


# --- indicators ---------------------------------------------------------------


def _indicator(code: str, severity: str, weight, detail: Column) -> Column:
    return F.struct(
        F.lit(code).alias("code"),
        F.lit(severity).alias("severity"),
        (weight if isinstance(weight, Column) else F.lit(float(weight))).alias("weight"),
        detail.alias("detail"),
    )


def _say(template: str, *parts: Column) -> Column:
    return F.format_string(template, *[F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


def _message_rules() -> list[tuple[Column, Column]]:
    spf, dkim, dmarc = (F.col(m) for m in AUTH_METHODS)
    sender = F.col("from_domain")
    claimed, brand = F.col("display_domain"), F.col("display_brand")
    return [
        (spf.isin("fail", "softfail"), _indicator("SPF_FAIL", "high", 0.25, _say("SPF %s for %s", spf, sender))),
        (dkim == "fail", _indicator("DKIM_FAIL", "high", 0.25, F.lit("DKIM signature does not verify"))),
        (dmarc == "fail", _indicator("DMARC_FAIL", "critical", 0.35, F.lit("DMARC policy of the sender domain failed"))),
        (
            F.col("dkim_aligned").eqNullSafe(False),
            _indicator("DKIM_MISALIGNED", "critical", 0.35, _say("signed by %s, sent as %s", F.col("signer"), sender)),
        ),
        (F.coalesce(spf, dkim, dmarc).isNull(), _indicator("NO_AUTH_RESULTS", "low", 0.05, F.lit("no SPF, DKIM or DMARC result"))),
        (
            (sender != "") & (claimed != "") & (claimed != sender),
            _indicator("DISPLAY_NAME_SPOOF", "high", 0.25, _say("display name says %s, sender is %s", claimed, sender)),
        ),
        (
            brand.isNotNull() & ~sender.contains(brand) & sender.isin(*fv.FREEMAIL),
            _indicator("BRAND_FROM_FREEMAIL", "high", 0.30, _say("claims %s, sent from %s", brand, sender)),
        ),
        (
            _differs("reply_to_domain"),
            _indicator("REPLY_TO_MISMATCH", "medium", 0.18, _say("replies go to %s, sender is %s", F.col("reply_to_domain"), sender)),
        ),
        (
            _differs("return_path_domain"),
            _indicator("RETURN_PATH_MISMATCH", "medium", 0.12, _say("envelope sender %s, header sender %s", F.col("return_path_domain"), sender)),
        ),
        (
            F.col("from_brand").isNotNull(),
            _indicator(
                "LOOKALIKE_SENDER_DOMAIN", "critical", 0.35,
                _say("%s is %s edits from %s", sender, F.col("from_brand_distance"), F.col("from_brand")),
            ),
        ),
    ]


def _url_rules(u: Column) -> list[tuple[Column, Column]]:
    domain = u["domain"]
    return [
        (u["anchor_mismatch"], _indicator("URL_ANCHOR_MISMATCH", "high", 0.25, _say("link text names another domain than %s", domain))),
        (_looks_imitated(u), _indicator("URL_HOMOGRAPH", "critical", 0.35, _say("%s imitates %s", domain, u["homograph_of"]))),
        (
            u["lookalike_brand"].isNotNull(),
            _indicator("URL_LOOKALIKE", "high", 0.28, _say("%s is %s edits from %s", domain, u["lookalike_distance"], u["lookalike_brand"])),
        ),
        (u["is_ip_literal"], _indicator("URL_IP_LITERAL", "high", 0.22, _say("link to a bare address: %s", u["url"]))),
        (u["has_credentials"], _indicator("URL_EMBEDDED_CREDENTIALS", "high", 0.25, F.lit("user part in front of the host"))),
        (u["is_shortener"], _indicator("URL_SHORTENER", "medium", 0.12, _say("shortened link on %s", domain))),
        (u["subdomain_depth"] >= 4, _indicator("URL_DEEP_SUBDOMAIN", "medium", 0.10, _say("deep subdomains: %s", u["url"]))),
    ]


def _attachment_rules(a: Column) -> list[tuple[Column, Column]]:
    return [
        (a["extension"].isin(*fv.EXECUTABLE_EXTENSIONS), _indicator("DANGEROUS_ATTACHMENT", "critical", 0.40, _say("executable %s", a["filename"]))),
        (a["extension"].isin(*fv.MACRO_EXTENSIONS), _indicator("MACRO_ATTACHMENT", "high", 0.25, _say("document with macros %s", a["filename"]))),
    ]


def _content_rules() -> list[tuple[Column, Column]]:
    names = F.concat_ws(", ", *[F.when(F.col(f"hits_{c}") > 0, c) for c in fv.PRESSURE_PHRASES])
    n = sc.total([(c > 0).cast("int") for c in _categories()])
    return [
        (n >= 2, _indicator("PRESSURE_LANGUAGE", "medium", F.least(F.lit(0.20), n * 0.06), _say("pressure tactics: %s", names))),
        (
            (F.col("hits_credential_bait") > 0) & (F.size("urls") > 0),
            _indicator("CREDENTIAL_HARVEST_PATTERN", "high", 0.25, F.lit("asks for credentials and offers a link")),
        ),
        (
            (F.col("private_ip_hops") > 0) & (F.col("hop_count") > 1),
            _indicator("PRIVATE_IP_IN_CHAIN", "info", 0.02, _say("%s private addresses on the way", F.col("private_ip_hops"))),
        ),
    ]


def _fired(rules: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, ind) for cond, ind in rules]))


def indicators_column() -> Column:
    """All findings in a fixed order: headers, sender, links in order, attachments, content."""
    return F.concat(
        _fired(_message_rules()),
        F.flatten(F.transform("urls", lambda u: _fired(_url_rules(u)))),
        F.flatten(F.transform("attachments", lambda a: _fired(_attachment_rules(a)))),
        _fired(_content_rules()),
    )


def with_indicators(signals: DataFrame) -> DataFrame:
    signer = F.col("dkim_domain") if "dkim_domain" in signals.columns else F.lit(None).cast("string")
    return signals.withColumn("signer", signer).withColumn("indicators", indicators_column()).drop("signer")


def email_indicators(signals: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """One row per finding, with its position in the message."""
    return sc.explode_rows(with_indicators(signals), [id_col], F.col("indicators"), "pos").select(id_col, "pos", "item.*")


def email_risk(signals: DataFrame, model_score: Column | None = None, model_version: str | None = None) -> DataFrame:
    """Fused risk and verdict; a model score, when there is one, takes the heuristic's place."""
    scored = with_indicators(signals)
    prior = sc.noisy_or(F.transform("indicators", lambda i: i["weight"]))
    scored = scored.withColumn("heuristic_risk", prior)
    risk = F.col("heuristic_risk") if model_score is None else sc.stable_round(model_score, 4)
    return scored.withColumn("risk_score", risk).withColumns(
        {
            "verdict": sc.email_verdict(F.col("risk_score")),
            "score_source": F.lit("heuristic" if model_score is None else "model"),
            "model_version": F.lit(model_version).cast("string"),
        }
    )


def explanation(indicators: Column) -> Column:
    """Deterministic analyst note: counts and the strongest finding."""
    # Descending weight, ties in the order the findings were made.
    ranked = F.array_sort(
        F.transform(indicators, lambda i, n: F.struct((-i["weight"]).alias("w"), n.alias("n"), i.alias("i")))
    )
    severe = lambda e: e["i"]["severity"].isin("critical", "high")

    def note(r: Column) -> Column:
        head = F.coalesce(F.get(F.filter(r, severe), F.lit(0)), F.get(r, F.lit(0)))["i"]
        return F.when(F.size(r) == 0, "No risk indicator was found.").otherwise(
            F.format_string(
                "%d indicator(s) found, %d of high severity. Strongest: %s (%s). Review before acting.",
                F.size(r), F.size(F.filter(r, severe)), head["code"], head["detail"],
            )
        )

    return sc.let(ranked, note)


def explain(risked: DataFrame) -> DataFrame:
    return risked.withColumn("explanation", explanation(F.col("indicators")))


def score_messages(messages: DataFrame, id_col: str = "msg_id") -> DataFrame:
    """Raw bytes to verdicts; stateless, so it also runs on a stream."""
    from tidewatch.sources.messages import parse_messages

    return explain(email_risk(message_signals(parse_messages(messages, id_col))))


