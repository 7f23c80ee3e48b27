"""Findings lifecycle: reconcile a scan with the table, set statuses, prune, compare snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.findings import cap_evidence, reject, sortable_id
from emberwatch.model import FINDING_SCHEMA, MODULE, STATE_SCHEMA, columns

STATE_COLUMNS, FINDING_COLUMNS = columns(STATE_SCHEMA), columns(FINDING_SCHEMA)
_REFRESHED = ("title", "severity", "remediation", "evidence")


@dataclass
class Reconciled:
    state: DataFrame
    newly_open: DataFrame
    resolved: DataFrame
    rejected: DataFrame
    unscanned: DataFrame


def reconcile(
    state: DataFrame, fresh: DataFrame, scanned: DataFrame, now: Column,
    module: str = MODULE, resolve_after: int = 1,
) -> Reconciled:
    """One scan of every target in ``scanned`` (column target) in one job.

    New findings open, resolved ones reopen, known ones are refreshed, and a finding missing from
    the scan is resolved after ``resolve_after`` scans in a row unless suppressed. Targets that were
    not scanned, and other modules, keep their rows; fresh findings of such targets come back as ``unscanned``. ``fresh`` may hold a ``seq``; of rows with one
    fingerprint the last wins.
    """
    need = max(resolve_after, 1)
    field, reason = reject()
    marked = fresh.withColumns({"reject_field": field, "reject_reason": reason})
    rejected = marked.where("reject_field is not null").select(*FINDING_COLUMNS, "reject_field", "reject_reason")
    order = F.col("seq") if "seq" in fresh.columns else F.lit(0)
    good = marked.where("reject_field is null").withColumn("evidence", cap_evidence(F.col("evidence")))
    good = (
        good.groupBy("target", "fingerprint")
        .agg(F.max_by(F.struct("check", *_REFRESHED), order).alias("f"))
    )
    scope = scanned.select("target").distinct().withColumn("_scanned", F.lit(True))
    old = state.where(F.col("module") == module).select(
        "target", "fingerprint", F.struct(*[c for c in STATE_COLUMNS if c not in ("target", "fingerprint")]).alias("s")
    )
    pairs = old.join(good, ["target", "fingerprint"], "full_outer").join(scope, "target", "left")
    in_scan, s, f = F.coalesce("_scanned", F.lit(False)), F.col("s"), F.col("f")
    streak = s["absent_streak"] + 1
    outcome = (
        F.when(~in_scan, "untouched")
        .when(s.isNull(), "new")
        .when(f.isNotNull() & (s["status"] == "resolved"), "reopened")
        .when(f.isNotNull(), "refreshed")
        .when(s["status"].isin("resolved", "suppressed"), "untouched")
        .when(streak >= need, "resolved")
        .otherwise("absent")
    )
    seen = F.col("_do").isin("new", "reopened", "refreshed")
    missing = F.col("_do").isin("resolved", "absent")
    pairs = pairs.withColumn("_do", outcome)
    unscanned = pairs.where(f.isNotNull() & ~in_scan).select("target", "fingerprint", "f.*")
    pairs = pairs.where(s.isNotNull() | in_scan)
    keep = lambda name: s[name]
    made = {
        "module": F.lit(module),
        "check": F.coalesce(keep("check"), f["check"]),
        **{c: F.when(seen, f[c]).otherwise(keep(c)) for c in _REFRESHED},
        "id": F.coalesce(keep("id"), sortable_id(now, F.col("fingerprint"))),
        "status": F.when(F.col("_do").isin("new", "reopened"), "open")
        .when(F.col("_do") == "resolved", "resolved").otherwise(keep("status")),
        "group_id": keep("group_id"),
        "first_seen": F.coalesce(keep("first_seen"), now),
        "last_seen": F.when(seen, now).otherwise(keep("last_seen")),
        "resolved_at": F.when(F.col("_do") == "resolved", now)
        .when(F.col("_do") == "reopened", F.lit(None)).otherwise(keep("resolved_at")),
        "absent_streak": F.when(seen, F.lit(0)).when(missing, streak).otherwise(keep("absent_streak")),
    }
    after = pairs.select("target", "fingerprint", "_do", *[c.alias(n) for n, c in made.items()])
    others = state.where(F.col("module") != module).select(*STATE_COLUMNS)
    return Reconciled(
        state=after.select(*STATE_COLUMNS).unionByName(others),
        newly_open=after.where("_do in ('new', 'reopened')").select(*STATE_COLUMNS),
        resolved=after.where("_do = 'resolved'").select(*STATE_COLUMNS),
        rejected=rejected,
        unscanned=unscanned,
    )


SETTABLE = ("acknowledged", "suppressed", "open")


def set_status(state: DataFrame, changes: DataFrame, module: str = MODULE) -> tuple[DataFrame, DataFrame]:
    """Apply (fingerprint, status, seq), the last valid change of a finding winning.

    Returns the new table and the refused changes with their reason.
    """
    allowed = F.col("status").isin(*SETTABLE)
    wanted = changes.where(allowed).groupBy("fingerprint").agg(F.max_by("status", "seq").alias("_to"))
    mine = F.col("module") == module
    after = (
        state.join(wanted, "fingerprint", "left")
        .withColumn("status", F.when(mine & F.col("_to").isNotNull(), F.col("_to")).otherwise(F.col("status")))
        .select(*STATE_COLUMNS)
    )
    known = state.where(mine).select("fingerprint", F.lit(True).alias("_known"))
    refused = (
        changes.join(known, "fingerprint", "left")
        .withColumn("reason", F.when(~allowed, "status must be acknowledged, suppressed, or open")
                    .when(F.col("_known").isNull(), "finding not found"))
        .where("reason is not null").drop("_known")
    )
    return after, refused


def prune_resolved(state: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Drop findings resolved before the cutoff; the second frame holds the number dropped."""
    old = F.coalesce((F.col("status") == "resolved") & (F.col("resolved_at") < cutoff), F.lit(False))
    return state.where(~old), state.where(old).agg(F.count(F.lit(1)).alias("pruned"))


def retention_cutoff(now: Column, days: int) -> Column:
    """Earliest resolved_at to keep; 0 days means for ever (NULL, which prunes nothing)."""
    return now - F.make_dt_interval(days=F.lit(days)) if days else F.lit(None).cast("timestamp")


def diff_findings(previous: DataFrame, current: DataFrame) -> DataFrame:
    """added / removed / changed between two sets of findings, with the fields that changed."""
    body = ("title", "severity", "remediation", "evidence")
    side = lambda df, name: df.select("target", "fingerprint", F.struct("check", *body).alias(name))
    both = side(previous, "a").join(side(current, "b"), ["target", "fingerprint"], "full_outer")
    a, b = F.col("a"), F.col("b")
    changed = F.array_join(F.array_compact(F.array(*[F.when(~a[c].eqNullSafe(b[c]), F.lit(c)) for c in body])), ",")
    return (
        both.withColumn("kind", F.when(a.isNull(), "added").when(b.isNull(), "removed").when(changed != "", "changed"))
        .where("kind is not null")
        .select("kind", "target", "fingerprint", F.coalesce(b, a).alias("_f"),
                F.when(F.col("kind") == "changed", changed).otherwise("").alias("detail"))
        .select("kind", "target", "fingerprint", "_f.*", "detail")
    )
