"""DuckDB text snippets shared by the oracles."""

from __future__ import annotations

from tidewatch.functions import fixed_values as fv


def str_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def str_tuple(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _clean(host: str) -> str:
    return f"trim(lower({host}), '.')"


def registrable(host: str) -> str:
    parts = f"string_split({_clean(host)}, '.')"
    two = f"array_to_string(list_slice({parts}, -2, -1), '.')"
    three = f"array_to_string(list_slice({parts}, -3, -1), '.')"
    return (
        f"(CASE WHEN len({parts}) <= 2 THEN {_clean(host)} WHEN {two} IN {str_tuple(fv.TWO_LABEL_SUFFIXES)} THEN {three} ELSE {two} END)"
    )


def brand_hit(label: str) -> str:
    """``[distance, index]`` of the nearest brand as one sortable number: distance * 64 + index."""
    # DuckDB counts bytes: one byte stands in for every letter outside ASCII.
    label = f"regexp_replace({label}, '[^\\x00-\\x7f]', '~', 'g')"
    pairs = ", ".join(f"levenshtein({label}, '{b}') * 64 + {i}" for i, b in enumerate(fv.BRANDS))
    return f"least({pairs})"


def tokens(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), "
        f"lambda tk: NOT list_contains({str_list(fv.STOPWORDS)}, tk))"
    )


def hits(text: str, phrases) -> str:
    return "(" + " + ".join("contains({}, '{}')::INT".format(text, p.replace("'", "''")) for p in phrases) + ")"
