"""Alert batches, digests and their renderings (text, JSON payloads, log lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberwatch.functions.findings import severity_rank
from emberwatch.functions.net import is_address
from emberwatch.functions.text import strip_space

# Fixed texts and numbers of the renderings.
BADGES = {"critical": "🟥 CRITICAL", "high": "🟧 HIGH", "medium": "🟨 MEDIUM", "low": "🟦 LOW"}
OTHER_BADGE = "⬜ INFO"
LINE_SEVERITY = {"critical": 2, "high": 3, "medium": 4, "low": 5}
OTHER_SEVERITY, RESOLVED_SEVERITY, FACILITY = 6, 5, 16
ADDRESS_KEYS = ("source_ip", "src_ip", "src", "actor", "client_ip", "ip")
LINE_LIMIT = 1600
BATCH_SECONDS, BATCH_EVENTS = 30, 100

ALERT_FIELDS = ("target", "check", "severity", "title", "remediation", "evidence")


def _choose(key: Column, table: dict, default) -> Column:
    out = F.lit(default) if not isinstance(default, Column) else default
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def passes(alerts: DataFrame, minimum: str = "") -> DataFrame:
    """Drop opened alerts below the minimum severity; resolutions always pass."""
    if not minimum:
        return alerts
    rank = severity_rank(F.col("severity"), unknown=0)
    return alerts.where((F.col("kind") != "opened") | (rank >= severity_rank(F.lit(minimum), unknown=0)))


def dedup(alerts: DataFrame) -> DataFrame:
    """First alert per (batch, kind, module, fingerprint); reduces before the shuffle."""
    keys = ["batch", "kind", "module", "fingerprint"]
    rest = [c for c in alerts.columns if c not in keys]
    return alerts.groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("_x")).select(*keys, "_x.*")


def digests(alerts: DataFrame) -> DataFrame:
    """One row per (module, batch): opened most severe first, resolved in order of arrival.

    A batch holds at most ``BATCH_EVENTS`` alerts by construction, which bounds the arrays.
    """
    item = F.struct(*ALERT_FIELDS)
    opened = F.when(F.col("kind") == "opened", F.struct((-severity_rank(F.col("severity"), 0)).alias("o"), "seq", item.alias("f")))
    closed = F.when(F.col("kind") == "resolved", F.struct("seq", item.alias("f")))
    bare = lambda c: F.transform(c, lambda x: x["f"])
    return (
        dedup(alerts).groupBy("module", "batch")
        .agg(
            F.max("at").alias("at"),
            F.sort_array(F.collect_list(opened)).alias("opened"),
            F.sort_array(F.collect_list(closed)).alias("resolved"),
        )
        .withColumns({"opened": bare("opened"), "resolved": bare("resolved")})
        .where("size(opened) + size(resolved) > 0")
    )


def digest_text(opened: Column, resolved: Column, module: Column, products: dict[str, str] | None = None) -> Column:
    """The plain message chat channels share; ``products`` gives display names of modules."""
    block = lambda f: F.concat(
        F.lit("\n"), _choose(f["severity"], BADGES, OTHER_BADGE), F.lit(" "), f["target"],
        F.lit("\n  "), f["title"], F.lit("\n  → "), f["remediation"], F.lit("\n"))
    line = lambda f: F.concat(F.lit("  • "), f["target"], F.lit(" — "), f["title"], F.lit("\n"))
    count = lambda c: F.size(c).cast("string")
    new = F.when(F.size(opened) > 0, F.concat(
        _choose(module, products or {}, module), F.lit(" — "), count(opened), F.lit(" new finding(s)\n"),
        F.array_join(F.transform(opened, block), "")))
    done = F.when(F.size(resolved) > 0, F.concat(
        F.when(F.size(opened) > 0, "\n").otherwise(""), F.lit("✅ "), count(resolved), F.lit(" finding(s) resolved\n"),
        F.array_join(F.transform(resolved, line), "")))
    return F.rtrim(F.concat(F.coalesce(new, F.lit("")), F.coalesce(done, F.lit(""))), F.lit("\n"))


def webhook_json(digest: DataFrame) -> DataFrame:
    """Versioned payload; empty lists and missing evidence are left out."""
    wire = lambda f: F.struct(
        f["target"].alias("target"), f["check"].alias("check"), f["severity"].alias("severity"),
        f["title"].alias("title"), f["remediation"].alias("remediation"),
        F.try_parse_json(f["evidence"]).alias("evidence"))
    some = lambda name: F.when(F.size(name) > 0, F.transform(name, wire)).alias(name)
    payload = F.to_json(F.struct(
        F.lit(1).alias("version"), "module", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"),
        some("opened"), some("resolved")))
    return digest.select("module", "batch", payload.alias("value"))


def chat_json(digest: DataFrame, products: dict[str, str] | None = None) -> DataFrame:
    text = digest_text(F.col("opened"), F.col("resolved"), F.col("module"), products)
    return digest.select("module", "batch", F.to_json(F.struct(text.alias("text"))).alias("value"))


def evidence_ip(evidence: Column) -> Column:
    """First of the usual address fields that holds a valid address as a text."""
    # Only a text can look like an address, so values of other types need no test. The document is parsed
    # once: as an element of an array it is bound before its fields are looked at.
    def first(doc: Column) -> Column:
        values = [strip_space(F.try_element_at(doc, F.lit(key))) for key in ADDRESS_KEYS]
        return F.coalesce(*[F.when(is_address(v), v) for v in values], F.lit(""))

    return F.transform(F.array(F.from_json(evidence, "map<string,string>")), first)[0]


def sanitize(c: Column, limit: int = LINE_LIMIT) -> Column:
    """One line of bounded size: CR, LF and NUL become blanks, the rest is cut after the last whole character within ``limit`` bytes."""
    one = F.translate(c, "\n\r\0", "   ")
    whole = F.make_valid_utf8(F.substring(one.cast("binary"), 1, limit).cast("string"))
    cut = F.regexp_replace(whole, "\ufffd+$", "")  # what a cut through a character leaves
    return F.when(F.octet_length(one) > limit, F.concat(cut, F.lit("…"))).otherwise(one)


def alert_priority(kind: Column, severity: Column, facility: int = FACILITY) -> Column:
    level = F.when(kind == "resolved", F.lit(RESOLVED_SEVERITY)).otherwise(
        _choose(F.lower(severity), LINE_SEVERITY, OTHER_SEVERITY))
    return F.lit((facility or FACILITY) * 8) + level


def alert_lines(alerts: DataFrame, host: str = "-", tag: str = "", pid: int = 0, facility: int = FACILITY) -> DataFrame:
    """One log line per alert; ``parse_syslog`` reads it back as a forwarded finding."""
    at, kind = F.col("at"), F.col("kind")
    done = kind == "resolved"
    stamp = F.concat(F.date_format(at, "MMM "), F.lpad(F.dayofmonth(at).cast("string"), 2, " "), F.date_format(at, " HH:mm:ss"))
    ip = evidence_ip(F.col("evidence"))
    body = F.concat(
        F.when(done, "RESOLVED: ").otherwise(""), F.col("title"),
        F.lit(" | product="), F.col("module"), F.lit(" severity="), F.col("severity"), F.lit(" check="), F.col("check"),
        F.lit(" target="), F.col("target"), F.lit(" status="), F.when(done, "resolved").otherwise("open"),
        F.when(ip != "", F.concat(F.lit(" src="), ip)).otherwise(""))
    name = F.lit(tag) if tag else F.col("module")
    line = F.concat(
        F.lit("<"), alert_priority(kind, F.col("severity"), facility).cast("string"), F.lit(">"), stamp,
        F.lit(f" {host or '-'} "), name, F.lit(f"[{pid}]: "), sanitize(body))
    return alerts.withColumn("value", line)


def assign_batches(alerts: DataFrame, seconds: int = BATCH_SECONDS, limit: int = BATCH_EVENTS) -> DataFrame:
    """Replay the batching: a batch opens with its first alert and closes after ``seconds`` or when
    ``limit`` different alerts wait. Duplicates inside a batch are dropped. Adds ``batch``.

    A pause of ``seconds`` always ends a batch, so the stretches between pauses are independent.
    """
    from emberwatch.operators.batching import replay

    return replay(alerts, seconds, limit)
