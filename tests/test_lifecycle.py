import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import findings as fn
from emberwatch.model import FINDING_SCHEMA, RECORD_SCHEMA, STATE_SCHEMA
from emberwatch.operators import records as rec, views as read
from emberwatch.operators.reconcile import diff_findings, prune_resolved, reconcile, retention_cutoff, set_status

T0 = dt.datetime(2026, 8, 17, 12)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def finding(fp="f1", target="web", check="c.x", title="t", severity="high", fix="do", evidence='{"a":1}'):
    return (fp, target, check, title, severity, fix, evidence)


def fresh(spark, *rows):
    return spark.createDataFrame(list(rows), FINDING_SCHEMA)


def lit(t):
    return F.lit(t).cast("timestamp")


class Table:
    """Runs reconcile rounds, keeping the table between them."""

    def __init__(self, spark, resolve_after=1):
        self.spark, self.need = spark, resolve_after
        self.rows = []

    def scan(self, minute, *found, targets=("web",)):
        state = self.spark.createDataFrame(self.rows, STATE_SCHEMA)
        scanned = self.spark.createDataFrame([(t,) for t in targets], "target string")
        out = reconcile(state, fresh(self.spark, *found), scanned, lit(at(minute)), resolve_after=self.need)
        self.rows = [tuple(r) for r in out.state.collect()]
        return ([r.fingerprint for r in out.newly_open.collect()], [r.fingerprint for r in out.resolved.collect()],
                [(r.reject_field, r.reject_reason) for r in out.rejected.collect()])

    def get(self, fp="f1"):
        names = [p.strip().split()[0] for p in STATE_SCHEMA.split(",")]
        return next(dict(zip(names, r)) for r in self.rows if r[3] == fp)


def test_reconcile_lifecycle(spark):
    t = Table(spark)
    assert t.scan(0, finding()) == (["f1"], [], [])
    first = t.get()
    assert (first["status"], first["first_seen"], len(first["id"])) == ("open", T0, 26)
    assert t.scan(5, finding(title="t2")) == ([], [], [])
    assert (t.get()["title"], t.get()["first_seen"], t.get()["last_seen"], t.get()["id"]) == ("t2", T0, at(5), first["id"])
    assert t.scan(10) == ([], ["f1"], [])
    assert (t.get()["status"], t.get()["resolved_at"]) == ("resolved", at(10))
    assert t.scan(15) == ([], [], [])
    assert t.scan(20, finding()) == (["f1"], [], [])
    assert (t.get()["status"], t.get()["resolved_at"], t.get()["absent_streak"]) == ("open", None, 0)
    # a target that was not scanned keeps its findings
    assert t.scan(25, finding("f2", "db"), targets=("db",)) == (["f2"], [], [])
    assert t.get()["status"] == "open"


def test_threshold_and_user_statuses(spark):
    t = Table(spark, resolve_after=2)
    t.scan(0, finding("f1"), finding("f2"), finding("f3"))
    names = {"f2": "suppressed", "f3": "acknowledged"}
    t.rows = [r[:9] + (names.get(r[3], r[9]),) + r[10:] for r in t.rows]
    assert t.scan(1) == ([], [], [])
    new, done, _ = t.scan(2)
    assert sorted(done) == ["f1", "f3"] and t.get("f2")["status"] == "suppressed" and t.get("f2")["absent_streak"] == 0
    assert t.scan(3, finding("f2"), finding("f3"))[0] == ["f3"]
    assert t.get("f2")["status"] == "suppressed"


def test_rejects_and_evidence_cap(spark):
    t = Table(spark)
    big = json.dumps({"x": "y" * 70_000}, separators=(",", ":"))
    new, _, bad = t.scan(0, finding("f1", fix=""), finding("f2", check="c.y", evidence=big), finding("f3", severity="odd"), finding("", title=""))
    assert new == ["f2"]
    assert sorted(bad) == [("fingerprint", "empty"), ("remediation", "empty (every finding must tell the user what to do)"),
                           ("severity", "unknown value: odd")]
    assert json.loads(t.get("f2")["evidence"])["_original_bytes"] == len(big)


def record(key="k", minute=0, first=None, severity="high", source="s1", title="t", seq=0, check="detect.scan"):
    return (source, key, check, severity, "1.1.1.1", "web", title, "d", ["l"], "fix", 3, at(first if first is not None else minute), at(minute), seq, 1)


def test_upsert_and_immediate_write(spark):
    old = rec.upsert_detections(None, spark.createDataFrame([record(minute=5, title="a", check="detect.x")], RECORD_SCHEMA))
    both = rec.upsert_detections(old, spark.createDataFrame([record(minute=9, first=1, title="b", seq=2), record(minute=7, title="c", seq=1)], RECORD_SCHEMA))
    r = both.first()
    assert (r.title, r.check, r.first_at, r.last_at) == ("b", "detect.x", at(1), at(9))
    state = rec.write_findings(None, both)
    row = state.first()
    assert (row.status, row.target, row.severity) == ("open", "s1", "high")
    held = state.withColumn("status", F.lit("suppressed"))
    assert rec.write_findings(held, both).first().status == "open"
    kept = rec.write_findings(held, both, respect_suppressed=True).first()
    assert (kept.status, kept.id) == ("suppressed", row.id)
    doc = json.loads(row.evidence)
    assert list(doc) == sorted(doc) and doc["first_seen"] == "2026-08-17T12:01:00Z"


def test_active_window_and_parse_rate(spark):
    dets = spark.createDataFrame([record("old", -120), record("new", -1), record("gone", -1, source="s9")], RECORD_SCHEMA)
    src = spark.createDataFrame([("s1", "file", {"path": "/x"}, True, T0)], "name string, type string, params map<string,string>, enabled boolean, created_at timestamp")
    rates = spark.createDataFrame([("s1", 10, 0.2), ("s9", 10, 0.1)], "source_id string, lines bigint, parse_rate double")
    out = rec.active_findings(dets, src, rates, lit(T0)).collect()
    assert sorted(r.check for r in out) == ["detect.scan", "ingest.parse_rate"]
    low = next(r for r in out if r.check == "ingest.parse_rate")
    assert json.loads(low.evidence) == {"parse_rate": 0.2, "type": "file"} and low.severity == "low"
    left = rec.prune_detections(dets, lit(at(-60))).count()
    assert left == 2
    cut = rec.delete_sources(src, dets, spark.createDataFrame([(" s1 ",)], "name string"))
    assert cut.sources.count() == 0 and [r.key for r in cut.detections.collect()] == ["gone"]


def test_status_changes_prune_diff_and_summary(spark):
    t = Table(spark)
    t.scan(0, finding("f1"), finding("f2", severity="low"), finding("f3"))
    state = spark.createDataFrame(t.rows, STATE_SCHEMA)
    changes = spark.createDataFrame([("f1", "suppressed", 1), ("f1", "acknowledged", 2), ("f2", "resolved", 3), ("zz", "open", 4)],
                                    "fingerprint string, status string, seq bigint")
    after, refused = set_status(state, changes)
    assert {r.fingerprint: r.status for r in after.collect()} == {"f1": "acknowledged", "f2": "open", "f3": "open"}
    assert sorted((r.fingerprint, r.reason) for r in refused.collect()) == [
        ("f2", "status must be acknowledged, suppressed, or open"), ("zz", "finding not found")]
    s = read.summary(after, spark.createDataFrame([("a",), ("b",)], "name string")).first()
    assert (s["counts"], s.open_total, s.targets) == ({"high": 1, "low": 1}, 2, 2)
    t.scan(1, finding("f1"))
    state = spark.createDataFrame(t.rows, STATE_SCHEMA)
    left, dropped = prune_resolved(state, lit(at(2)))
    assert left.count() == 1 and dropped.first().pruned == 2
    assert prune_resolved(state, retention_cutoff(lit(T0), 0))[1].first().pruned == 0
    kinds = diff_findings(fresh(spark, finding("f1"), finding("f2")), fresh(spark, finding("f2", title="new"), finding("f3"))).collect()
    assert sorted((r.kind, r.fingerprint, r.detail) for r in kinds) == [("added", "f3", ""), ("changed", "f2", "title"), ("removed", "f1", "")]


def test_views_order(spark):
    t = Table(spark)
    t.scan(0, finding("f1", severity="low"), finding("f2", severity="critical"), finding("f3"))
    names = {"f2": ("resolved", at(-60 * 25)), "f3": ("resolved", at(-5)), "f1": ("open", None)}
    rows = [r[:9] + (names[r[3]][0],) + r[10:13] + (names[r[3]][1],) + r[14:] for r in t.rows]
    view = read.findings_view(spark.createDataFrame(rows, STATE_SCHEMA), lit(T0), ranked=True).collect()
    assert [r.fingerprint for r in view] == ["f1", "f3"]
    dets = spark.createDataFrame([record("a", -1), record("b", -2, check="incident.killchain"), record("c", -40)], RECORD_SCHEMA)
    src = spark.createDataFrame([("s1",)], "name string")
    assert [r.key for r in read.incidents_view(dets, src, lit(T0)).collect()] == ["a", "b"]
    assert [r.key for r in read.incidents_view(dets, src, lit(T0), ranked=True).collect()] == ["b", "a"]


def test_ids(spark):
    df = spark.createDataFrame([(T0, "x"), (at(1), "x"), (T0, "y")], "t timestamp, s string")
    ids = [r[0] for r in df.select(fn.sortable_id(F.col("t"), F.col("s"))).collect()]
    assert all(len(i) == 26 for i in ids) and ids[0] < ids[1] and ids[0][:10] == ids[2][:10] and ids[0] != ids[2]
