"""Address tests as native patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_H = "[0-9a-fA-F]{1,4}"


def _v6_pattern() -> str:
    """All IPv6 spellings: eight groups, or fewer around one ``::``, with an optional IPv4 tail."""
    forms = [f"({_H}:){{7}}{_H}", f"({_H}:){{6}}{_V4}"]
    for lead in range(8):
        head = f"{_H}(:{_H}){{{lead - 1}}}" if lead else ""
        room = 7 - lead
        tails = []
        if room >= 1:
            tails.append(f"{_H}(:{_H}){{0,{room - 1}}}")
        if room >= 2:
            tails.append(f"({_H}:){{0,{room - 2}}}{_V4}")
        forms.append(f"{head}::({'|'.join(tails)})?" if tails else f"{head}::")
    return "|".join(f"({f})" for f in forms)


IPV4_PATTERN = f"^{_V4}$"
IPV6_PATTERN = f"^({_v6_pattern()})$"


def is_address(c: Column) -> Column:
    """True for exactly one IPv4 or IPv6 address."""
    return c.rlike(IPV4_PATTERN) | (c.contains(":") & c.rlike(IPV6_PATTERN))


def is_ip(c: Column) -> Column:
    """As ``is_address``, after dropping brackets at both ends."""
    return is_address(F.btrim(c, F.lit("[]")))


def is_private_ip(c: Column) -> Column:
    """Loopback, private or link-local address."""
    mapped = F.regexp_replace(F.lower(c), r"^(0{0,4}:){1,5}:?ffff:(?=[0-9.]+$)", "")
    v4 = mapped.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    v6 = mapped.rlike("^f[cd][0-9a-f]{2}:|^fe[89ab][0-9a-f]:") | mapped.rlike("^[0:]*:0{0,3}1$")
    return is_address(c) & F.when(mapped.contains(":"), v6).otherwise(v4)
