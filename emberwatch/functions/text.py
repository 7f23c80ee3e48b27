"""Small shared column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters that count as white space at the ends of a text.
SPACE = "\t\n\u000b\u000c\r \u0085                 　"
EMPTY = ""


def text(value: str) -> Column:
    return F.lit(value)


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def or_default(c: Column, default: str) -> Column:
    """The text, or a label when it is empty."""
    return F.when(c == "", F.lit(default)).otherwise(c)


def dash_to_empty(c: Column) -> Column:
    return F.when(c == "-", F.lit("")).otherwise(c)


def human_bytes(n: Column) -> Column:
    """``512 B``, ``1.5 KB``, ``70.0 MB`` ... in steps of 1024."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", start=1):
        scaled = one_decimal(n.cast("double") / F.lit(float(1024**power)))
        out = F.when(n >= F.lit(1024**power), F.concat(scaled, F.lit(f" {unit}B"))).otherwise(out)
    return out


def one_decimal(x: Column) -> Column:
    """One decimal place, exact halves to even (1.25 -> 1.2)."""
    return F.call_function("format_number", x, F.lit("0.0"))


def rfc3339(ts: Column) -> Column:
    """UTC time with whole seconds (the session runs in UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def span_text(seconds: int) -> str:
    """A duration as 30s, 1m0s, 2h3m0s."""
    hours, rest = divmod(int(seconds), 3600)
    minutes, secs = divmod(rest, 60)
    if hours:
        return f"{hours}h{minutes}m{secs}s"
    return f"{minutes}m{secs}s" if minutes else f"{secs}s"


def digits(c: Column, kind: str = "int") -> Column:
    """Number in an extracted text, NULL when nothing was extracted or it is out of range.

    The empty text is tested first: a failing cast raises and catches an exception per row.
    """
    return F.when(c != "", c.try_cast(kind))
