"""Micro-batch jobs around the findings tables: alerts to files and the periodic backstop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.model import DETECTION_KEEP_S, MODULE, RECORD_SCHEMA, STATE_SCHEMA
from emberwatch.operators import notify, records as rec
from emberwatch.operators.reconcile import reconcile
from emberwatch.plans.lineage import pin, release
from emberwatch.plans.pipeline import transition_alerts
from emberwatch.sources.snapshots import Snapshots


def alert_sink(alerts: DataFrame, folder: str, checkpoint: str, minimum: str = "", host: str = "-", **trigger) -> StreamingQuery:
    """Digests and log lines of every trigger's alerts, in batches of bounded size without duplicates.

    The micro-batch number names the folders, so a replayed batch overwrites itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        kept = pin(notify.assign_batches(notify.passes(batch, minimum)))
        digest = notify.digests(kept)
        notify.alert_lines(kept, host=host).select("value").write.mode("overwrite").text(f"{folder}/lines/batch={number}")
        notify.webhook_json(digest).select("value").write.mode("overwrite").text(f"{folder}/webhook/batch={number}")
        notify.chat_json(digest).select("value").write.mode("overwrite").text(f"{folder}/chat/batch={number}")
        release(kept)

    return _start(alerts, write, checkpoint, trigger or {"processingTime": "30 seconds"})


def record_sink(records: DataFrame, detections: Snapshots, findings: Snapshots, checkpoint: str, module: str = MODULE,
                **trigger) -> StreamingQuery:
    """Fold fired records into the keyed detections table and the findings table.

    Each table remembers the last batch of this stream it took, so a replay after a failure between
    the two writes, or after a backstop round, changes only what is missing.
    """
    def write(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        rows = pin(batch)
        detections.update(RECORD_SCHEMA, lambda old: rec.upsert_detections(old, rows), stream, number, rows.select("source_id", "key"))
        touched = rec.findings(rows, module).select(F.lit(module).alias("module"), "fingerprint")
        findings.update(STATE_SCHEMA, lambda old: rec.write_findings(old, rows, module), stream, number, touched)
        release(rows)

    return _start(records, write, checkpoint, trigger or {"processingTime": "10 seconds"})


@dataclass
class Round:
    """What a backstop round wrote: the table's version, alerts for what opened and resolved, refused findings."""

    version: int
    alerts: DataFrame
    rejected: DataFrame


def backstop_round(detections: DataFrame, sources: DataFrame, rates: DataFrame | None, findings: Snapshots, now,
                   module: str = MODULE, resolve_after: int = 1) -> Round:
    """One reconcile of all sources on the newest findings."""
    fresh = pin(rec.active_findings(detections, sources, rates, now, module=module))
    targets = sources.select(F.col("name").alias("target"))
    done = None

    def change(old: DataFrame) -> DataFrame:
        nonlocal done
        done = reconcile(old, fresh, targets, now, module, resolve_after)
        return done.state

    version = findings.update(STATE_SCHEMA, change)
    return Round(version, transition_alerts(done, now), done.rejected)


def periodic_rounds(clock: DataFrame, detections: Snapshots, sources: Callable[[], DataFrame], findings: Snapshots, folder: str,
                    checkpoint: str, rates: Callable[[], DataFrame] | None = None, module: str = MODULE, resolve_after: int = 1,
                    keep_s: int = DETECTION_KEEP_S, **trigger) -> StreamingQuery:
    """A backstop round per trigger: what is quiet resolves, old detections go, and the alerts about it land in ``folder``.

    ``clock`` is a stream with a column ``timestamp``, such as the rate source; its latest time is now. Every round
    reads the newest snapshots. Its alerts are written under its number before it is committed, so a round that
    is repeated after a failure writes them again (at least once); a committed round is not repeated.
    """
    def write(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("timestamp")).first()[0]
        if now is None:
            return
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        at, registered = F.lit(now).cast("timestamp"), pin(sources())
        targets = registered.select(F.col("name").alias("target"))
        fresh = pin(rec.active_findings(detections.read(RECORD_SCHEMA), registered, rates() if rates else None, at, module=module))

        def change(old: DataFrame) -> DataFrame:
            done = reconcile(old, fresh, targets, at, module, resolve_after)
            transition_alerts(done, at).coalesce(1).write.mode("overwrite").parquet(f"{folder}/round={number}")
            return done.state

        findings.update(STATE_SCHEMA, change, stream, number)
        before = at - F.make_dt_interval(secs=F.lit(keep_s))
        detections.update(RECORD_SCHEMA, lambda old: rec.prune_detections(old, before), stream, number)
        release(registered)
        release(fresh)

    return _start(clock, write, checkpoint, trigger or {"processingTime": "5 minutes"})


def _start(df: DataFrame, write: Callable, checkpoint: str, trigger: dict) -> StreamingQuery:
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
