"""Line framing: RFC 5424, RFC 3164 and plain lines to the event layout, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.fields import extract_fields
from emberwatch.functions.text import dash_to_empty, digits, strip_space
from emberwatch.model import EVENT_SCHEMA, columns

EVENT_COLUMNS = columns(EVENT_SCHEMA)

_STAMP = (
    r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) +([0-9]{1,2}) +"
    r"([0-9]{1,2}):([0-9]{2}):([0-9]{2}([.,][0-9]+)?)$"
)
_ISO = (
    r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{1,2}):([0-9]{2}):([0-9]{2}([.,][0-9]+)?)"
    r"(Z|[+-][0-9]{2}:[0-9]{2})$"
)
# Fixed value: month names in order, three letters each.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_PRI = "^<([0-9]{1,3}|[+-][0-9]{1,2})>"


def _seconds(c: Column) -> Column:
    whole = F.substring(F.replace(c, F.lit(","), F.lit(".")), 1, 9)
    return digits(whole, "decimal(8,6)")


def _make(year, month, day, hour, minute, sec: Column) -> Column:
    # 60 seconds is not a valid clock reading here, although Spark would roll it over.
    return F.when(sec < 60, F.try_make_timestamp(year, month, day, hour, minute, sec))


# The spellings nearly all lines use; they are read with one cast instead of a group per field.
_USUAL_STAMP = "^[A-Z][a-z]{2} [ 0-3][0-9] [0-2][0-9]:[0-5][0-9]:[0-5][0-9]$"
_USUAL_ISO = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-2][0-9]:[0-5][0-9]:[0-5][0-9](\.[0-9]+)?"
    "(Z|[+-](0[0-9]|1[0-7]):[0-5][0-9])$"
)


def _month(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(name))
    return F.when(at % 3 == 1, ((at + 2) / 3).cast("int"))


def stamp_time(stamp: Column, now: Column) -> Column:
    """``Jan _2 15:04:05`` in the year of ``now``; NULL if malformed. 29 Feb rolls to 1 Mar."""
    text = F.concat_ws(
        "-", F.year(now), _month(F.substring(stamp, 1, 3)), F.ltrim(F.substring(stamp, 5, 11)))
    usual = F.when(stamp.rlike(_USUAL_STAMP) & _month(F.substring(stamp, 1, 3)).isNotNull(), text.try_cast("timestamp"))
    return F.coalesce(usual, F.when(stamp.rlike(_STAMP), _any_stamp(stamp, now)))


def _any_stamp(stamp: Column, now: Column) -> Column:
    part = lambda i: F.regexp_extract(stamp, _STAMP, i)
    num = lambda i: digits(part(i))
    month = _month(part(1))
    year = F.year(now)
    clock = (num(3), num(4), _seconds(part(5)))
    leap_day = _make(year, F.lit(3), F.lit(1), *clock)
    plain = _make(year, month, num(2), *clock)
    rolled = F.when((month == 2) & (num(2) == 29), leap_day)
    return F.coalesce(plain, rolled)


def iso_time(c: Column) -> Column:
    """RFC 3339 time with an explicit zone; NULL if malformed (bare dates are malformed)."""
    usual = F.when(c.rlike(_USUAL_ISO), c.try_cast("timestamp"))
    return F.coalesce(usual, F.when(c.rlike(_ISO), _any_iso(c)))


def _any_iso(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, _ISO, i)
    num = lambda i: digits(part(i))
    zone = part(8)
    zone_hours, zone_minutes = digits(F.substring(zone, 2, 2)), digits(F.substring(zone, 5, 2))
    minutes = F.when(zone == "Z", F.lit(0)).otherwise(
        zone_hours * 60 + zone_minutes
    ) * F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    local = _make(num(1), num(2), num(3), num(4), num(5), _seconds(part(6)))
    zone_ok = (zone_hours <= 24) & (zone_minutes <= 60)
    at = F.timestamp_micros(F.unix_micros(local) - minutes.cast("bigint") * 60_000_000)
    return F.when((zone == "Z") | zone_ok, at)


def priority(line: Column) -> Column:
    """Leading ``<N>`` in 0..191, else NULL."""
    n = digits(F.regexp_extract(line, _PRI, 1))
    return F.when(n.between(0, 191), n)


def strip_structured_data(c: Column) -> Column:
    """Drop ``-`` or the first balanced ``[...]`` block in front of the message."""
    s = strip_space(c)
    flat = r"^\[[^\[\]]*\]"
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(0).alias("cut"))

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "[", 1).when(ch == "]", -1).otherwise(0)
        closes = (acc["cut"] == 0) & (ch == "]") & (depth == 0)
        return F.struct(
            (acc["pos"] + 1).alias("pos"), depth.alias("depth"),
            F.when(closes, acc["pos"] + 1).otherwise(acc["cut"]).alias("cut"),
        )

    cut = F.aggregate(F.split(s, ""), start, step)["cut"]
    nested = F.when(cut > 0, strip_space(F.substring(s, cut + 1, F.length(s)))).otherwise(s)
    return (
        F.when(s.startswith("- "), F.substring(s, F.lit(3), F.length(s)))
        .when(s == "-", F.lit(""))
        .when(s.rlike(flat), strip_space(F.regexp_replace(s, flat, "")))
        .when(s.startswith("["), nested)
        .otherwise(s)
    )


def _bsd_columns(rest: Column, now: Column) -> dict[str, Column]:
    """RFC 3164 parts; ``_bsd_ts`` is NULL when the text is not in that form."""
    long_enough = F.octet_length(rest) >= 16
    return {
        "_bsd_ts": F.when(long_enough, stamp_time(F.substring(rest, 1, 15), now)),
        "_remain": strip_space(F.substring(rest, F.lit(16), F.length(rest))),
    }


def _split_bsd(df: DataFrame) -> DataFrame:
    """From ``_remain`` derive host, tag and message of an RFC 3164 line (tag NULL if absent)."""
    remain, tail = F.col("_remain"), F.col("_tail")
    tag = F.substring_index(tail, ":", 1)
    tagged = F.col("_remain").contains(" ") & tail.contains(":") & F.octet_length(tag).between(1, 63)
    return (
        df.withColumn("_tail", strip_space(F.substring(remain, F.instr(remain, " ") + 1, F.length(remain))))
        .withColumns({
            "_bsd_host": F.when(remain.contains(" "), F.substring_index(remain, " ", 1)),
            "_bsd_app": F.when(tagged, F.substring_index(tag, "[", 1)),
            "_bsd_msg": F.when(~remain.contains(" "), remain)
            .when(tagged, strip_space(F.substring(tail, F.instr(tail, ":") + 1, F.length(tail))))
            .otherwise(tail),
        })
        .drop("_tail")
    )


def _finish(df: DataFrame) -> DataFrame:
    return extract_fields(df).select(*EVENT_COLUMNS)


def parse_syslog(lines: DataFrame, source: str = "syslog") -> DataFrame:
    """Events from (value, recv_ts, seq, source_id): RFC 5424, then RFC 3164, then the bare rest.

    A line without a priority keeps its whole text as the message and counts as not parsed.
    ``source`` is ``windows`` for a forwarder's listener.
    """
    line, rest, now = F.col("raw"), F.col("_rest"), F.col("recv_ts")
    f = F.col("_f")
    framed = F.col("_pri").isNotNull()
    is5424 = framed & rest.startswith("1 ") & (F.size(f) == 7)
    is3164 = framed & F.col("_bsd_ts").isNotNull()
    staged = (
        lines.withColumn("raw", F.rtrim(F.col("value"), F.lit("\r\n")))
        .withColumn("_pri", priority(line))
        .withColumn("_rest", F.when(framed, F.regexp_replace(line, _PRI, "")).otherwise(line))
        .withColumn("_f", F.split(rest, " ", 7))
        .withColumn("_new", is5424)
        .withColumns(_bsd_columns(rest, now))
    )
    is_new = F.col("_new")
    return _finish(
        _split_bsd(staged).withColumns({
            "ts": F.when(is_new, F.coalesce(iso_time(f[1]), now)).when(is3164, F.col("_bsd_ts")).otherwise(now),
            "source": F.lit(source),
            "host": F.when(is_new, dash_to_empty(f[2])).when(is3164, F.coalesce("_bsd_host", F.lit(""))).otherwise(F.lit("")),
            "app": F.when(is_new, dash_to_empty(f[3])).when(is3164, F.coalesce("_bsd_app", F.lit(""))).otherwise(F.lit("")),
            "severity": F.coalesce(F.pmod("_pri", F.lit(8)), F.lit(-1)),
            "message": F.when(is_new, strip_structured_data(F.try_element_at(f, F.lit(7))))
            .when(is3164, F.col("_bsd_msg")).otherwise(rest),
            "parsed": is_new | is3164,
        })
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Events from (value, recv_ts, seq, source, source_id, host, app): files, journal, containers.

    A BSD header in front gives time, host and app; configured host and app win over it.
    """
    line, now = F.col("raw"), F.col("recv_ts")
    is3164 = F.col("_bsd_ts").isNotNull()
    given = lambda name: F.when(F.col(name) != "", F.col(name))
    staged = (
        lines.withColumn("raw", F.rtrim(F.col("value"), F.lit("\r\n")))
        .withColumns(_bsd_columns(line, now))
    )
    return _finish(
        _split_bsd(staged).withColumns({
            "ts": F.coalesce("_bsd_ts", now),
            "host": F.when(is3164, F.coalesce(given("host"), "_bsd_host", F.lit(""))).otherwise(F.col("host")),
            "app": F.when(is3164, F.coalesce(given("app"), "_bsd_app", F.lit(""))).otherwise(F.col("app")),
            "severity": F.lit(-1),
            "message": F.when(is3164, F.col("_bsd_msg")).otherwise(line),
            "parsed": F.lit(True),
        })
    )
