import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.model import EVENT_SCHEMA, ChainConfig, DetectConfig
from emberwatch.operators import correlate, detectors

from oracle import chain, simulate

EPOCH = dt.datetime(2026, 8, 17, 12)
BASE_US = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def event(us, seq, **kw):
    row = dict(us=us, seq=seq, source="syslog", source_id="s1", host="web01", app="sshd", severity=6, message="",
               auth="", user="", src_ip="", dst_port=0, bytes_out=0, action="", raw=f"line {seq}", parsed=True)
    row.update(kw)
    return row


def events_df(spark, rows):
    names = [p.strip().split(" ")[0] for p in EVENT_SCHEMA.split(",")]
    data = [tuple(EPOCH + dt.timedelta(microseconds=r["us"]) if n == "ts" else r[n] for n in names) for r in rows]
    return spark.createDataFrame(data, EVENT_SCHEMA)


def found(df):
    rows = df.select("kind", "key", F.unix_micros("last_at").alias("us"), "seq", "count",
                     F.unix_micros("first_at").alias("first"), "evidence").collect()
    return sorted((r.kind, r.key, r.us - BASE_US, r.seq, r["count"], r["first"] - BASE_US, tuple(r.evidence)) for r in rows)


def random_events(seed, n=700, span_s=900, ticks=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        us = rng.randrange(span_s * ticks) * (1_000_000 // ticks)
        ip = rng.choice(["", "9.9.9.1", "9.9.9.2", "9.9.9.3", "9.9.9.4"])
        rows.append(event(
            us, i, src_ip=ip, user=rng.choice(["", "al", "bo"]), host=rng.choice(["", "web1", "web2"]),
            auth=rng.choice(["failure", "failure", "success", ""]), dst_port=rng.choice([0, 1, 2, 3, 4, 5, 6]),
            bytes_out=rng.choice([0, 1000, 5000, 900_000]), action=rng.choice(["", "", "new_admin"]),
            raw=rng.choice(["", f"raw {i}"])))
    return rows


@pytest.mark.parametrize("seed,ticks,cooldown", [(1, 1, 60), (2, 1000, 60), (3, 1, 12)])
def test_all_detectors_match_simulation(spark, seed, ticks, cooldown):
    rows = random_events(seed, ticks=ticks)
    cfg = DetectConfig(brute_failures=4, brute_window_s=20, scan_ports=5, scan_window_s=30, exfil_bytes=1_000_000,
                       exfil_factor=2.0, exfil_window_s=10, spike_min=6, spike_window_s=15, cooldown_s=cooldown, evidence_max=3)
    got = found(detectors.detect_all(events_df(spark, rows), cfg))
    want = sorted(simulate(rows, cfg))
    assert {w[0] for w in want} == {"brute_force", "scan", "exfil", "new_admin", "auth_spike"}
    assert got == want


@pytest.mark.parametrize("seed", [3, 4])
def test_chain_matches_simulation(spark, seed):
    rows = [e for e in random_events(seed, n=500, span_s=3000)]
    for i, e in enumerate(rows):
        if i % 9 == 0 and e["src_ip"]:
            e.update(message=f"bait | product=trap severity=high check=trap.trip status=open src={e['src_ip']}")
    cfg = DetectConfig(brute_failures=3, brute_window_s=60, scan_ports=4, scan_window_s=60, cooldown_s=90)
    ev = events_df(spark, rows)
    dets = detectors.detect_all(ev, cfg, {k: detectors.DETECTORS[k] for k in ("brute_force", "scan", "sentinel_finding")})
    listed = [(r.kind, r.actor, r.us - BASE_US, r.seq, r.ord)
              for r in dets.select("kind", "actor", F.unix_micros("last_at").alias("us"), "seq", "ord").collect()]
    got = correlate.incidents(ev, dets, ChainConfig(100, 150)).select(
        "actor", F.unix_micros("last_at").alias("us"), "severity", "stages", F.unix_micros("first_at").alias("f")).collect()
    want = chain(rows, listed, 100_000_000, 150_000_000)
    assert {s for w in want for s in w[3]} == {"scan", "brute_force", "success", "deception"}
    assert sorted((r.actor, r.us - BASE_US, r.severity, tuple(r.stages), r.f - BASE_US) for r in got) == sorted(want)


def seconds(n):
    return n * 1_000_000


def test_literal_sequences(spark):
    def run(rows, name, **cfg):
        return detectors.DETECTORS[name](events_df(spark, rows), DetectConfig.of(**cfg)).collect()

    fails = [event(seconds(i), i, auth="failure", src_ip="203.0.113.9", user="root") for i in range(8)]
    got = run(fails[:5], "brute_force", brute_failures=5)
    assert [(d.count, d.title, d.detail) for d in map(lambda r: Row(r), got)] == [
        (5, "Brute force: 5 failed logins from 203.0.113.9", "5 authentication failures within 1m0s (target web01).")]
    assert run(fails[:7], "brute_force") == []
    slow = [event(seconds(5 * i), i, auth="failure", src_ip="203.0.113.9") for i in range(8)]
    assert run(slow, "brute_force", brute_failures=5, brute_window_s=10) == []
    ports = [event(0, i, src_ip="198.51.100.7", dst_port=20 + i) for i in range(6)]
    assert len(run(ports, "scan", scan_ports=6)) == 1
    same = [event(seconds(i), i, src_ip="198.51.100.7", dst_port=443) for i in range(10)]
    assert run(same, "scan", scan_ports=5) == []
    assert len(run([event(0, 0, action="new_admin", user="x")], "new_admin")) == 1
    out = [event(0, 0, bytes_out=1000), event(seconds(120), 1, bytes_out=2000)]
    out += [event(seconds(240) + i, 2 + i, bytes_out=20 * 2**20) for i in range(3)]
    assert len(run(out, "exfil", exfil_bytes=2**20, exfil_factor=3.0)) == 1
    spread = [event(seconds(i), i, auth="failure", src_ip=f"10.0.0.{i}") for i in range(12)]
    assert [r.actor for r in run(spread, "auth_spike", spike_min=12)] == ["web01/sshd"]
    single = [event(seconds(i), i, auth="failure", src_ip="10.0.0.1") for i in range(20)]
    assert run(single, "auth_spike", spike_min=12) == []
    # a cooldown no longer than the window: the window starts anew after every fire
    assert [r["count"] for r in run(single, "brute_force", brute_failures=5, brute_window_s=600, cooldown_s=4)] == [5, 5, 5, 5]
    ports = [event(seconds(i), i, src_ip="198.51.100.7", dst_port=20 + i % 7) for i in range(30)]
    assert [r["count"] for r in run(ports, "scan", scan_ports=6, scan_window_s=600, cooldown_s=600)] == [6]
    assert [r["count"] for r in run(ports, "scan", scan_ports=6, scan_window_s=20, cooldown_s=10)] == [6, 7, 7]
    assert len(run(spread, "auth_spike", spike_min=3, spike_sources=3, spike_window_s=600, cooldown_s=2)) == 4


class Row:
    def __init__(self, r):
        self.count, self.title, self.detail = r["count"], r["title"], r["detail"]


def test_chain_stages_run_side_by_side(spark, monkeypatch):
    """Each detector waits until all three have begun."""
    from threading import Barrier

    from emberwatch.plans import catalog

    together = Barrier(3)

    def waiting(kind):
        def detector(events, cfg):
            together.wait(20)
            return events.withColumn("kind", F.lit(kind))

        return detector

    for name in ("brute_force", "port_scan", "forwarded_finding"):
        monkeypatch.setattr(catalog.detectors, name, waiting(name))
    got = catalog.chain_stages(spark.range(2), lambda: spark.range(1))
    assert sorted((r.id, r.kind) for r in got.collect()) == [
        (0, "brute_force"), (0, "forwarded_finding"), (0, "port_scan"), (1, "brute_force"), (1, "port_scan")]
