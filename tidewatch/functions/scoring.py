"""Small scoring expressions: bands, verdicts, fusion and guards (all native columns)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv

CRITICAL = 0.85
SUSPICIOUS = 0.55
LOW_CONFIDENCE = 0.25


def let(expr: Column, body) -> Column:
    """Bind ``expr`` once and use it many times inside a lambda body."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def explode_rows(df: DataFrame, keys: list, array: Column, position: str | None = None) -> DataFrame:
    """One row per element: ``keys``, the optional position and the element as ``item``.

    The outer form plus a filter on its output is deliberate.  For the inner form
    the optimizer adds a size filter below the generator, which evaluates the
    whole array expression a second time per row.
    """
    if position is None:
        out = df.select(*keys, F.explode_outer(array).alias("item"))
    else:
        out = df.select(*keys, F.posexplode_outer(array).alias(position, "item"))
    return out.filter(F.col("item").isNotNull())


def stable_round(value: Column, digits: int) -> Column:
    """Half-up rounding that ignores the order in which a sum was built.

    The first rounding removes the last bits of floating-point noise, so that
    0.016049999999999998 and 0.01605 round alike.
    """
    return F.round(F.round(value, 12), digits)


def total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def risk_band(score: Column) -> Column:
    return F.when(score >= CRITICAL, "critical").when(score >= SUSPICIOUS, "suspicious").otherwise("benign")


def email_verdict(score: Column) -> Column:
    return (
        F.when(score >= CRITICAL, "phishing")
        .when(score >= SUSPICIOUS, "suspicious")
        .when(score >= LOW_CONFIDENCE, "low_confidence")
        .otherwise("benign")
    )


def enum_guard(value: Column, allowed: Sequence[str], default: str | None = None) -> Column:
    """The value when it is allowed, else NULL (or the default)."""
    kept = F.when(value.isin(*allowed), value)
    return kept if default is None else F.coalesce(kept, F.lit(default))


def noisy_or(weights: Column) -> Column:
    """Fuse an array of weights so that weak signals never add up to certainty."""
    fused = F.aggregate(weights, F.lit(0.0), lambda r, w: r + w * (1.0 - r))
    return stable_round(F.least(fused, F.lit(0.99)), 4)


def noisy_or_agg(weight: Column) -> Column:
    """The same fusion as an aggregate over rows."""
    return stable_round(F.least(1.0 - F.product(1.0 - weight), F.lit(0.99)), 4)


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "high", 1).when(severity == "medium", 2).otherwise(3)


def triage_risk(level: Column) -> Column:
    names = list(fv.LEVEL_RISK)
    chain = F.when(level == names[0], fv.LEVEL_RISK[names[0]])
    for name in names[1:]:
        chain = chain.when(level == name, fv.LEVEL_RISK[name])
    return chain.otherwise(0.3)


# --- scan history -----------------------------------------------------------


def _leading_number(text: Column) -> Column:
    """Number at the start of the text, NULL when there is none."""
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def history_severity(result: Column) -> Column:
    """High / Medium / Low out of the free-text scan result."""
    low = F.lower(result)
    percent = F.when(low.contains("%"), _leading_number(low))

    def mentions(*words: str) -> Column:
        return reduce(lambda a, b: a | b, [low.contains(w) for w in words])

    high = mentions("critical", "high", "fake", "misleading") | F.coalesce(percent < 50, F.lit(False))
    medium = mentions("medium", "low", "suspicious") | F.coalesce((percent >= 50) & (percent < 75), F.lit(False))
    return F.when(high, "High").when(medium, "Medium").otherwise("Low")


def history_risk(kind: Column, result: Column) -> Column:
    """0..100 risk used to sort the scan history."""
    percent = F.coalesce(F.regexp_extract(result, r"(\d+)%", 1).try_cast("int"), F.lit(0))
    level = F.upper(result)
    by_level = (
        F.when(level == "CRITICAL", 100).when(level == "HIGH", 75).when(level == "MEDIUM", 50)
        .when(level == "LOW", 25).otherwise(0)
    )
    return F.when(kind == "NEWS", F.lit(100) - percent).otherwise(by_level)
