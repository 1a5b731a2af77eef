"""Link extraction and link findings, kept inside the row as arrays.

A message's links never leave its row until a caller explodes them, so neither
extraction nor scoring needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions import domains as dm
from tidewatch.functions.scoring import let
from tidewatch.functions.text import SPACE, strip

_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
# Unicode-aware word boundaries, as the pattern's contract asks for.
_DOMAIN_TOKEN = fv.PATTERN_DOMAIN_TOKEN.replace("(?i)", "(?iU)")


def percent_decode(text: Column) -> Column:
    """Decode %XX; plus signs and broken escapes stay as they are."""
    safe = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), text)


def _tidy(url: Column) -> Column:
    return F.regexp_replace(strip(url), r"[.,;)]+$", "")


def _first_per_url(entries: Column) -> Column:
    """Drop repeats, keeping first occurrences in order: one sort by url, one back by position."""
    tagged = F.transform(entries, lambda e, i: F.struct(e["url"].alias("url"), i.alias("pos"), e["anchor"].alias("anchor")))
    firsts = let(
        F.array_sort(tagged),
        lambda s: F.filter(s, lambda e, i: ~F.get(s, i - 1)["url"].eqNullSafe(e["url"])),
    )
    return F.array_sort(
        F.transform(firsts, lambda e: F.struct(e["pos"].alias("pos"), e["url"].alias("url"), e["anchor"].alias("anchor")))
    )


def link_entries(plain: Column, html: Column) -> Column:
    """Anchors first, then plain-text links, then bare links in the tag-free HTML."""
    html, plain = F.coalesce(html, F.lit("")), F.coalesce(plain, F.lit(""))
    anchors = F.zip_with(
        F.regexp_extract_all(html, F.lit(fv.PATTERN_ANCHOR), 1),
        F.regexp_extract_all(html, F.lit(fv.PATTERN_ANCHOR), 2),
        lambda href, label: F.struct(_tidy(percent_decode(href)).alias("url"), label.alias("anchor")),
    )
    pattern = F.lit(fv.PATTERN_PLAIN_URL.replace(r"\s", SPACE.strip("[]")))
    bare = F.concat(
        F.regexp_extract_all(plain, pattern, 0),
        F.regexp_extract_all(F.regexp_replace(html, fv.PATTERN_TAG, " "), pattern, 0),
    )
    loose = F.transform(bare, lambda u: F.struct(_tidy(u).alias("url"), F.lit(None).cast("string").alias("anchor")))
    return _first_per_url(F.filter(F.concat(anchors, loose), lambda e: e["url"] != ""))


def _extend(array: Column, **fields) -> Column:
    def add(x: Column) -> Column:
        out = x
        for name, build in fields.items():
            out = out.withField(name, build(x))
        return out

    return F.transform(array, add)


def _netloc(url: Column) -> Column:
    # Line breaks and tabs inside a link do not count.
    return F.regexp_extract(F.regexp_replace(url, r"[\x09\x0a\x0d]", ""), _NETLOC, 1)


def _host(netloc: Column) -> Column:
    address = F.regexp_replace(netloc, r"^.*@", "")
    bracketed = F.regexp_extract(address, r"\[([^\]]*)\]", 1)
    host = F.when(address.contains("["), bracketed).otherwise(F.substring_index(address, ":", 1))
    broken = netloc.contains("[") != netloc.contains("]")
    return F.when(broken, "").otherwise(F.lower(host))


def claimed_domain(text: Column) -> Column:
    """First domain-looking token of a text, as a registrable domain ('' when none)."""
    return dm.registrable_domain(F.regexp_extract(text, _DOMAIN_TOKEN, 1))


def link_findings(plain: Column, html: Column) -> Column:
    """``array<struct>`` with the twelve findings of every distinct link."""
    step = _extend(link_entries(plain, html), netloc=lambda e: _netloc(e["url"]))
    step = _extend(step, host=lambda e: _host(e["netloc"]))
    step = F.filter(step, lambda e: e["host"] != "")
    step = _extend(
        step,
        registrable=lambda e: dm.registrable_domain(e["host"]),
        folded=lambda e: dm.fold_confusables(e["host"]),
        is_ip=lambda e: dm.is_ip_literal(e["host"]),
        claimed=lambda e: claimed_domain(F.regexp_replace(e["anchor"], fv.PATTERN_TAG, "")),
    )
    step = _extend(
        step,
        domain=lambda e: F.when(e["is_ip"], e["host"]).otherwise(e["registrable"]),
        label=lambda e: F.substring_index(e["registrable"], ".", 1),
    )
    step = _extend(step, key=lambda e: F.when(~e["is_ip"], dm.brand_key(e["label"])))

    def finding(e: Column) -> Column:
        return F.struct(
            e["url"].alias("url"),
            e["domain"].alias("domain"),
            e["anchor"].alias("anchor_text"),
            F.coalesce((e["claimed"] != "") & (e["claimed"] != e["domain"]), F.lit(False)).alias("anchor_mismatch"),
            (e["host"].startswith("xn--") | e["host"].contains(".xn--")).alias("is_punycode"),
            F.when(e["folded"] != e["host"], dm.registrable_domain(e["folded"])).alias("homograph_of"),
            dm.brand_name(e["key"], e["label"]).alias("lookalike_brand"),
            dm.brand_distance(e["key"], e["label"]).alias("lookalike_distance"),
            e["registrable"].isin(*fv.SHORTENERS).alias("is_shortener"),
            e["is_ip"].alias("is_ip_literal"),
            e["netloc"].contains("@").alias("has_credentials"),
            F.greatest(F.lit(0), F.length(e["host"]) - F.length(F.replace(e["host"], F.lit("."), F.lit(""))) - 1).alias("subdomain_depth"),
        )

    return F.transform(step, finding)
