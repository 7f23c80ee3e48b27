"""From detections and incidents to keyed detection records, findings and the findings table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.findings import (
    cap_evidence, compact_json, fingerprint, is_severity, reject, sortable_id,
)
from emberwatch.functions.text import rfc3339
from emberwatch.model import (
    ACTIVE_WINDOW_S, FINDING_SCHEMA, INCIDENT_CHECK, MODULE, PARSE_RATE_CHECK, RECORD_SCHEMA, STATE_SCHEMA, columns,
)

RECORD_COLUMNS, FINDING_COLUMNS, STATE_COLUMNS = columns(RECORD_SCHEMA), columns(FINDING_SCHEMA), columns(STATE_SCHEMA)

# Fixed texts: what to do about each kind of detection.
DEFAULT_FIX = "Investigate the actor and affected host."
FIXES = {
    "brute_force": "Block the source IP and confirm no login succeeded. Enforce rate-limiting / fail2ban and key-only auth.",
    "scan": "Confirm the source is authorised. Block it at the perimeter if not; ensure only intended ports are exposed.",
    "exfil": "Investigate the outbound transfer from this host now — unexpected large egress can be data exfiltration.",
    "new_admin": "Verify this account/privilege grant was authorised and change-controlled. If not, disable it and investigate.",
    "auth_spike": "Likely credential stuffing — enable rate-limiting/MFA and watch for any success from the same sources.",
}
INCIDENT_FIX = "Treat as a possible compromise: isolate the host, rotate the affected credential, and review the session."
PARSE_RATE_FIX = (
    "Many lines from this source aren't being parsed — check the source type and format. "
    "Unparsed lines are stored but not analysed."
)


def fix_for(kind: Column) -> Column:
    out = F.lit(DEFAULT_FIX)
    for name, fix in FIXES.items():
        out = F.when(kind == name, F.lit(fix)).otherwise(out)
    return out


def detection_records(detections: DataFrame) -> DataFrame:
    return detections.withColumn("check", F.concat(F.lit("detect."), F.col("kind"))).withColumn(
        "fix", fix_for(F.col("kind"))
    ).select(*RECORD_COLUMNS)


def incident_records(incidents: DataFrame) -> DataFrame:
    """One evidence line per timeline member: time, stage, note."""
    line = lambda m: F.concat(rfc3339(m["at"]), F.lit("  ["), m["stage"], F.lit("]  "), m["note"])
    return incidents.withColumns({
        "check": F.lit(INCIDENT_CHECK),
        "fix": F.lit(INCIDENT_FIX),
        "evidence": F.transform("members", line),
        "count": F.size("members").cast("bigint"),
    }).select(*RECORD_COLUMNS)


def upsert_detections(previous: DataFrame | None, records: DataFrame) -> DataFrame:
    """Keyed table of (source_id, key): earliest first_at, newest description, original identity.

    Only combinable aggregates, so a key that holds most of the records is reduced before the shuffle.
    """
    rows = records.withColumn("_gen", F.lit(1))
    if previous is not None:
        rows = previous.withColumn("_gen", F.lit(0)).unionByName(rows)
    turn = F.struct("_gen", "last_at", "seq", "ord")
    newest = ["severity", "title", "detail", "evidence", "count", "last_at", "seq", "ord"]
    kept = ["check", "actor", "target", "fix"]
    return (
        rows.groupBy("source_id", "key")
        .agg(
            F.min("first_at").alias("first_at"),
            F.max_by(F.struct(*newest), turn).alias("_new"),
            F.min_by(F.struct(*kept), turn).alias("_old"),
        )
        .select("source_id", "key", "first_at", "_new.*", "_old.*")
        .select(*RECORD_COLUMNS)
    )


def findings(records: DataFrame, module: str = MODULE) -> DataFrame:
    """Map records to findings; the target is the source the record came from."""
    opt = lambda name: F.when(F.col(name) != "", F.col(name))
    evidence = compact_json(F.struct(
        F.col("actor"), F.col("count"), opt("detail").alias("detail"),
        F.when(F.size("evidence") > 0, F.col("evidence")).alias("evidence"),
        rfc3339(F.col("first_at")).alias("first_seen"), rfc3339(F.col("last_at")).alias("last_seen"),
        opt("target").alias("target"),
    ))
    return records.select(
        fingerprint(F.lit(module), F.col("source_id"), F.col("check"), F.col("key")).alias("fingerprint"),
        F.col("source_id").alias("_target"), "check", "title",
        F.when(is_severity(F.col("severity")), F.col("severity")).otherwise("medium").alias("severity"),
        F.when(F.trim("fix") == "", F.lit(DEFAULT_FIX)).otherwise(F.col("fix")).alias("remediation"),
        evidence.alias("evidence"), "first_at", "last_at", "seq", "ord",
    ).withColumnRenamed("_target", "target")


def write_findings(
    state: DataFrame | None, records: DataFrame, module: str = MODULE, respect_suppressed: bool = False
) -> DataFrame:
    """Immediate path: every record opens its finding, also over a resolved or acknowledged one.

    Identity and first_seen of an existing row stay. ``respect_suppressed`` keeps a suppressed row
    suppressed. Invalid findings are left out and oversized evidence is replaced, as in reconcile.
    """
    turn = F.struct("_gen", "last_seen", "seq", "ord")
    field, _ = reject()
    null_ts, null_text = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    fresh = (
        findings(records, module).where(field.isNull())
        .withColumns({
            "evidence": cap_evidence(F.col("evidence")), "module": F.lit(module), "status": F.lit("open"),
            "id": sortable_id(F.col("last_at"), F.col("fingerprint")), "group_id": null_text,
            "resolved_at": null_ts, "absent_streak": F.lit(0), "_gen": F.lit(1),
        })
        .withColumnsRenamed({"first_at": "first_seen", "last_at": "last_seen"})
    )
    rows = fresh
    if state is not None:
        old = state.withColumns({"seq": F.lit(0).cast("bigint"), "ord": F.lit(0), "_gen": F.lit(0)})
        rows = old.unionByName(fresh)
    newest = ["title", "severity", "remediation", "evidence", "status", "group_id", "last_seen", "resolved_at", "absent_streak"]
    merged = rows.groupBy("module", "fingerprint").agg(
        F.min_by(F.struct("id", "target", "check", "first_seen", F.col("status").alias("_was")), turn).alias("_old"),
        F.max_by(F.struct(*newest), turn).alias("_new"),
    ).select("module", "fingerprint", "_old.*", "_new.*")
    if respect_suppressed:
        merged = merged.withColumn(
            "status", F.when(F.col("_was") == "suppressed", F.lit("suppressed")).otherwise(F.col("status")))
    return merged.select(*STATE_COLUMNS)


def parse_rates(events: DataFrame) -> DataFrame:
    """Share of parsed events per source."""
    return events.groupBy("source_id").agg(
        F.sum(F.col("parsed").cast("bigint")).alias("hits"), F.count(F.lit(1)).alias("lines")
    ).select("source_id", "lines", (F.col("hits") / F.col("lines")).alias("parse_rate"))


def parse_rate_findings(sources: DataFrame, rates: DataFrame, module: str = MODULE, floor: float = 0.5) -> DataFrame:
    """A low finding for each registered source that parses badly; unseen sources count as 1.0."""
    low = sources.join(rates, sources["name"] == rates["source_id"]).where(F.col("parse_rate") < floor)
    check = F.lit(PARSE_RATE_CHECK)
    return low.select(
        fingerprint(F.lit(module), F.col("name"), check, F.lit("")).alias("fingerprint"),
        F.col("name").alias("target"), check.alias("check"),
        F.concat(F.lit("Low parse rate on source "), F.col("name")).alias("title"),
        F.lit("low").alias("severity"), F.lit(PARSE_RATE_FIX).alias("remediation"),
        compact_json(F.struct("parse_rate", "type")).alias("evidence"),
    )


def active_findings(
    detections: DataFrame, sources: DataFrame, rates: DataFrame | None, now: Column,
    active_s: int = ACTIVE_WINDOW_S, module: str = MODULE,
) -> DataFrame:
    """Findings that still hold: recent detections of registered sources, plus poor parse rates."""
    names = sources.select(F.col("name").alias("source_id"))
    recent = detections.where(F.col("last_at") >= now - F.make_dt_interval(secs=F.lit(active_s)))
    out = findings(recent.join(names, "source_id", "left_semi"), module).select(*FINDING_COLUMNS)
    return out if rates is None else out.unionByName(parse_rate_findings(sources, rates, module))


def prune_detections(detections: DataFrame, before: Column) -> DataFrame:
    return detections.where(F.col("last_at") >= before)


@dataclass
class Registry:
    sources: DataFrame
    detections: DataFrame


def delete_sources(sources: DataFrame, detections: DataFrame, names: DataFrame) -> Registry:
    """Remove the named sources and everything detected on them."""
    gone = names.select(F.trim("name").alias("name"))
    return Registry(
        sources.join(gone, "name", "left_anti"),
        detections.join(gone.withColumnRenamed("name", "source_id"), "source_id", "left_anti"),
    )
