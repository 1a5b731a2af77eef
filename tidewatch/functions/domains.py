"""Host and domain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv


def registrable_domain(host: Column) -> Column:
    """Last two labels, or three when the last two are a public suffix."""
    clean = F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    two = F.substring_index(clean, ".", -2)
    return F.when(two.isin(*fv.TWO_LABEL_SUFFIXES), F.substring_index(clean, ".", -3)).otherwise(two)


def host_label(host: Column) -> Column:
    return F.substring_index(registrable_domain(host), ".", 1)


def brand_key(label: Column) -> Column:
    """Nearest brand as ``distance * 64 + list index``; distances over 2 read as 3.

    ``levenshtein`` with a threshold of 2 gives -1 beyond it and stops early, and
    ``pmod(-1, 4)`` is 3, so one ``least`` finds the winner with ties in list order.
    """
    keys = [F.pmod(F.levenshtein(label, F.lit(b), 2), F.lit(4)) * 64 + i for i, b in enumerate(fv.BRANDS)]
    return F.least(*keys)


def brand_distance(key: Column, label: Column) -> Column:
    """1 or 2 for a near miss, else NULL (an exact match is legitimate use)."""
    distance = F.floor(key / 64).cast("int")
    return F.when(distance.isin(1, 2) & (F.length(label) >= 4), distance)


def brand_name(key: Column, label: Column) -> Column:
    names = F.array(*[F.lit(b) for b in fv.BRANDS])
    return F.when(brand_distance(key, label).isNotNull(), F.element_at(names, (F.pmod(key, F.lit(64)) + 1).cast("int")))


def fold_confusables(text: Column) -> Column:
    return F.translate(text, fv.CONFUSABLE_LETTERS, fv.CONFUSABLE_TARGETS)


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_HEX_RUN = r"(?:[0-9a-f]{1,4}:)*[0-9a-f]{1,4}"


def is_ip_literal(host: Column) -> Column:
    """A plain IPv4 or IPv6 address."""
    bare = F.regexp_replace(F.lower(host), r"^[\[\]]+|[\[\]]+$", "")
    full6 = bare.rlike(r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")
    short6 = bare.rlike(rf"^(?:{_HEX_RUN})?::(?:{_HEX_RUN})?$") & (F.regexp_count(bare, F.lit(r"[0-9a-f]+")) <= 7)
    return F.coalesce(bare.rlike(_IPV4) | full6 | short6, F.lit(False))


def _octet(ip: Column, n: int) -> Column:
    return F.split_part(ip, F.lit("."), F.lit(n)).cast("int")


def is_private_ipv4(ip: Column) -> Column:
    """Member of the IANA special-purpose (not globally reachable) IPv4 blocks."""
    a, b, c, d = (_octet(ip, n) for n in (1, 2, 3, 4))
    doc = ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    # 192.0.0.9 and 192.0.0.10 are the two globally reachable addresses inside 192.0.0.0/24.
    reachable = (a == 192) & (b == 0) & (c == 0) & d.isin(9, 10)
    private = (
        a.isin(0, 10, 127)
        | (a >= 240)
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 198) & b.isin(18, 19))
        | doc
    )
    return F.when(ip.rlike(_IPV4), private & ~reachable).otherwise(F.lit(False))
