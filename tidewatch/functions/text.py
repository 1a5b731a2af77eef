"""Text expressions: tokens, phrase hits, stance, sentences, ratings, writing style."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.scoring import let, total

# White space as a Unicode class that Java and RE2 read alike.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WORD = r"\p{L}\p{N}_"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapse_spaces(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def strip_tags(html: Column, replacement: str = " ") -> Column:
    return F.regexp_replace(html, fv.PATTERN_TAG, replacement)


def body_text(plain: Column, html: Column) -> Column:
    """Plain part, or the HTML without tags when there is none; white space collapsed."""
    return collapse_spaces(F.when(plain != "", plain).otherwise(strip_tags(F.coalesce(html, F.lit("")))))


def body_sha256(body: Column) -> Column:
    return F.when(body != "", F.sha2(body, 256))


def tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)
    return F.filter(words, lambda t: ~t.isin(*fv.STOPWORDS))


def phrase_hits(lowered: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur; one ``contains`` each, no array in between."""
    return total([lowered.contains(p).cast("int") for p in phrases])


def mentions(lowered: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in phrases])


def stance(claim_tokens: Column, evidence_tokens: Column) -> Column:
    """``struct(stance, score)`` of a claim against a passage by token overlap and negation."""
    negations = F.array(*[F.lit(w) for w in fv.NEGATIONS])

    def judge(pair: Column) -> Column:
        claim, shared = pair["claim"], pair["shared"]
        overlap = F.size(shared) / F.size(claim)
        flipped = pair["claim_negated"] != pair["evidence_negated"]
        confidence = F.least(0.5 + overlap * 0.45, F.lit(0.95))
        empty = (F.size(claim) == 0) | (pair["n_evidence"] == 0)
        return F.struct(
            F.when(empty | (overlap < 0.25), "neutral").when(flipped, "contradict").otherwise("entail").alias("stance"),
            F.when(empty, 0.5).when(overlap < 0.25, 0.5 + 0.3 * (1 - overlap)).otherwise(confidence).alias("score"),
        )

    def prepare(t: Column) -> Column:
        return F.struct(
            t["claim"].alias("claim"),
            F.array_intersect(t["claim"], t["evidence"]).alias("shared"),
            F.size(t["evidence"]).alias("n_evidence"),
            F.arrays_overlap(t["claim"], negations).alias("claim_negated"),
            F.arrays_overlap(t["evidence"], negations).alias("evidence_negated"),
        )

    both = F.struct(F.array_distinct(claim_tokens).alias("claim"), evidence_tokens.alias("evidence"))
    return let(both, lambda t: let(prepare(t), judge))


def sentences(text: Column, min_chars: int = 40) -> Column:
    """Trimmed sentences longer than ``min_chars``, in order."""
    gap = fv.PATTERN_SENTENCE_GAP.replace(r"\s", SPACE)
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), gap), strip)
    return F.filter(pieces, lambda s: F.length(s) > min_chars)


def claims(text: Column, max_claims: int | None = None, fallback_chars: int | None = None) -> Column:
    """Checkable sentences; the text itself when no sentence is long enough.

    Whole texts are read.  ``max_claims`` and ``fallback_chars`` cut the list and
    the fallback for callers who want a bounded answer per text.
    """
    found = sentences(text)
    if max_claims is not None:
        found = F.slice(found, 1, max_claims)
    whole = F.coalesce(text, F.lit(""))
    if fallback_chars is not None:
        whole = F.left(whole, F.lit(fallback_chars))
    return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(whole)))


def summary_line(text: Column, width: int = 280) -> Column:
    line = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > width, F.concat(F.left(line, F.lit(width)), F.lit("…"))).otherwise(line)


def rating_score(rating: Column) -> Column:
    """Fact-check wording to a 0..100 score; the first matching rule wins."""
    r = F.lower(F.coalesce(rating, F.lit("")))
    plainly_false = r.contains("false") & ~r.contains("mostly true") & ~r.contains("not false")
    return (
        F.when(r.contains("pants on fire") | r.contains("fabricated") | plainly_false, 12)
        .when(mentions(r, fv.RATING_PARTLY), 40)
        .when(mentions(r, fv.RATING_TRUE) | (strip(r) == "true"), 85)
        .when(mentions(r, fv.RATING_OPEN), 50)
        .otherwise(45)
    )


def writing_style(text: Column) -> dict[str, Column]:
    """Raw signals of the writing-style estimate."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    year = fv.PATTERN_YEAR.replace(r"\b", "", 1).replace(r"\b", "").replace(r"\d", r"\p{Nd}")
    percent = fv.PATTERN_PERCENT.replace(r"\b", "").replace(r"\d", r"\p{Nd}")
    figures = text.rlike(rf"(^|[^{_WORD}]){year}($|[^{_WORD}])") | text.rlike(rf"(^|[^{_WORD}]){percent}[{_WORD}]")
    return {
        "sensational": phrase_hits(low, fv.SENSATIONAL),
        "conspiracy": phrase_hits(low, fv.CONSPIRACY),
        "death_rumour": mentions(low, fv.DEATH_RUMOUR),
        "sourcing": phrase_hits(low, fv.SOURCING),
        "exclamations": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "shouting": (letters > 20) & (capitals / F.nullif(letters, F.lit(0)) > 0.3),
        "figures": figures,
    }


def style_score(s: dict[str, Column]) -> Column:
    """5..90 credibility out of the writing-style signals."""
    raw = (
        F.lit(55)
        - F.least(F.lit(30), s["sensational"] * 10)
        - F.least(F.lit(38), s["conspiracy"] * 19)
        - F.when(s["death_rumour"], 16).otherwise(0)
        + F.least(F.lit(24), s["sourcing"] * 8)
        - F.when(s["exclamations"] >= 2, F.least(F.lit(15), s["exclamations"] * 4)).otherwise(0)
        - F.when(s["shouting"], 12).otherwise(0)
        + F.when(s["figures"], 6).otherwise(0)
    )
    return F.greatest(F.lit(5), F.least(F.lit(90), raw)).cast("int")


def style_verdict(score: Column) -> Column:
    return (
        F.when(score < 25, "Fake News").when(score < 40, "Misleading").when(score >= 65, "Credible").otherwise("Unverified")
    )


def style_notes(s: dict[str, Column]) -> Column:
    """Names of the signals that fired, joined for the analyst."""
    return F.concat_ws(
        "; ",
        F.when(s["sensational"] > 0, F.concat(s["sensational"].cast("string"), F.lit(" sensational"))),
        F.when(s["conspiracy"] > 0, F.concat(s["conspiracy"].cast("string"), F.lit(" conspiracy"))),
        F.when(s["death_rumour"], "death rumour"),
        F.when(s["sourcing"] > 0, F.concat(s["sourcing"].cast("string"), F.lit(" sourcing"))),
        F.when(s["exclamations"] >= 2, "exclamation marks"),
        F.when(s["shouting"], "capital letters"),
        F.when(s["figures"], "figures or dates"),
    )
