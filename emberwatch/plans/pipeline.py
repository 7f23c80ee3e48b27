"""The two ways findings come about, each as one plan over all sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.model import MODULE, ChainConfig, DetectConfig
from emberwatch.operators import records as rec
from emberwatch.operators.correlate import incidents
from emberwatch.operators.detectors import Detector, detect_all
from emberwatch.operators.notify import ALERT_FIELDS
from emberwatch.operators.reconcile import Reconciled, reconcile
from emberwatch.plans.lineage import pin


@dataclass
class Immediate:
    records: DataFrame
    detections: DataFrame
    findings: DataFrame
    alerts: DataFrame


def fired_records(events: DataFrame, cfg: DetectConfig, chain: ChainConfig,
                  detectors: dict[str, Detector] | None = None, stored: bool = False) -> DataFrame:
    """Detections and the incidents built on them, as records.

    Every detector scans the events with its own few columns and filters, so freshly parsed events
    are written once as a table; pass ``stored=True`` for events that already are one.
    """
    if not stored:
        events = pin(events)
    # The few detections feed both the records and the correlation; pinning them runs the detectors once.
    found = pin(detect_all(events, cfg, detectors))
    return rec.detection_records(found).unionByName(rec.incident_records(incidents(events, found, chain)))


def immediate(events: DataFrame, cfg: DetectConfig, chain: ChainConfig, detections: DataFrame | None = None,
              findings: DataFrame | None = None, module: str = MODULE, stored: bool = False,
              detectors: dict[str, Detector] | None = None) -> Immediate:
    """Events to the keyed detections table, the findings table and one opened alert per fire."""
    records = pin(fired_records(events, cfg, chain, detectors, stored))
    return Immediate(
        records, rec.upsert_detections(detections, records), rec.write_findings(findings, records, module), record_alerts(records, module))


def record_alerts(records: DataFrame, module: str = MODULE) -> DataFrame:
    """One opened alert per fired record."""
    return rec.findings(records, module).select(
        F.lit("opened").alias("kind"), F.lit(module).alias("module"), F.col("last_at").alias("at"), "seq", "ord",
        "fingerprint", *ALERT_FIELDS)


def backstop(detections: DataFrame, sources: DataFrame, rates: DataFrame | None, findings: DataFrame, now: Column,
             scanned: DataFrame | None = None, module: str = MODULE, resolve_after: int = 1) -> Reconciled:
    """Re-affirm what still holds and resolve the rest.

    By default every registered source is scanned; pass ``scanned`` (column target) to include
    deleted sources too, so that their findings are resolved.
    """
    targets = scanned if scanned is not None else sources.select(F.col("name").alias("target"))
    fresh = rec.active_findings(detections, sources, rates, now, module=module)
    return reconcile(findings, fresh, targets, now, module, resolve_after)


def transition_alerts(result: Reconciled, now: Column) -> DataFrame:
    """Alerts for what a reconcile opened and resolved."""
    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "module", now.alias("at"), "fingerprint", *ALERT_FIELDS)

    both = rows(result.newly_open, "opened").unionByName(rows(result.resolved, "resolved"))
    return both.withColumn("seq", F.xxhash64("kind", "fingerprint"))
