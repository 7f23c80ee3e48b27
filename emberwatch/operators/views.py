"""Read-side queries: summary, findings, incidents, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.findings import severity_rank
from emberwatch.functions.text import rfc3339
from emberwatch.model import ACTIVE_WINDOW_S, MODULE


def open_findings(state: DataFrame, module: str = MODULE) -> DataFrame:
    return state.where((F.col("module") == module) & (F.col("status") == "open"))


def open_counts(state: DataFrame, module: str = MODULE) -> DataFrame:
    """Open findings per severity; only severities that occur."""
    return open_findings(state, module).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def summary(state: DataFrame, sources: DataFrame, product: str = "Emberwatch", module: str = MODULE) -> DataFrame:
    """One row: product, open counts as a map, their total and the number of targets."""
    counts = open_counts(state, module)
    packed = counts.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("severity", "n")))).alias("counts"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("open_total"),
    )
    targets = sources.agg(F.count(F.lit(1)).alias("targets"))
    # Both sides are global aggregates of one row.
    return packed.crossJoin(targets).select(F.lit(product).alias("product"), "counts", "open_total", "targets")


def findings_view(state: DataFrame, now: Column, module: str = MODULE, hide_suppressed: bool = False,
                  ranked: bool = False) -> DataFrame:
    """Findings newest first, without those resolved more than a day ago.

    ``ranked`` gives the dashboard order: open first, then most severe, then newest.
    """
    stale = (F.col("status") == "resolved") & (
        F.col("resolved_at").isNull() | (now - F.col("resolved_at") > F.expr("interval 24 hours")))
    out = state.where((F.col("module") == module) & ~stale)
    if hide_suppressed:
        out = out.where(F.col("status") != "suppressed")
    newest = F.desc("last_seen")
    if ranked:
        out = out.orderBy((F.col("status") == "open").desc(), severity_rank(F.col("severity")).desc(), newest)
    else:
        out = out.orderBy(newest)
    return out.select("fingerprint", "target", "check", "title", "severity", "status", "remediation",
                      "evidence", "first_seen", "last_seen")


def findings_of(state: DataFrame, target: str | None = None, fingerprint: str | None = None, module: str = MODULE) -> DataFrame:
    """The module's findings of one target or with one fingerprint (or both)."""
    out = state.where(F.col("module") == module)
    if target is not None:
        out = out.where(F.col("target") == target)
    return out if fingerprint is None else out.where(F.col("fingerprint") == fingerprint)


def detections_of(detections: DataFrame, source_id: str) -> DataFrame:
    return detections.where(F.col("source_id") == source_id).orderBy(F.desc("last_at"))


def incidents_view(detections: DataFrame, sources: DataFrame, now: Column, active_s: int = ACTIVE_WINDOW_S,
                   ranked: bool = False) -> DataFrame:
    """Live detections by source name and newest first; ``ranked`` puts incidents on top."""
    live = detections.where(F.col("last_at") >= now - F.make_dt_interval(secs=F.lit(active_s)))
    out = live.join(sources.select(F.col("name").alias("source_id")), "source_id").withColumn(
        "incident", F.col("check").startswith("incident."))
    order = [F.col("source_id"), F.desc("last_at")]
    return out.orderBy(*([F.desc("incident")] if ranked else []), *order).select(
        "key", F.col("source_id").alias("source"), "check", "severity", "actor", "target", "title", "detail",
        "evidence", "count", rfc3339(F.col("first_at")).alias("first_at"), rfc3339(F.col("last_at")).alias("last_at"),
        "incident")


def source_list(sources: DataFrame, rates: DataFrame) -> DataFrame:
    """Registered sources by name with their parse rate, 1.0 while nothing was seen."""
    seen = rates.select(F.col("source_id").alias("name"), "parse_rate")
    return sources.join(seen, "name", "left").withColumn(
        "parse_rate", F.coalesce("parse_rate", F.lit(1.0))).orderBy("name")
