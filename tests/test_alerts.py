import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from emberwatch.functions.syslog import parse_syslog
from emberwatch.operators import batching, notify, verify

T0 = dt.datetime(2026, 8, 19, 13, 52, 1)
SCHEMA = ("kind string, module string, batch bigint, at timestamp, seq bigint, fingerprint string, target string, check string, "
          "severity string, title string, remediation string, evidence string")


def alert(seq, fp="f", kind="opened", severity="high", title="Bait", evidence='{"source_ip":"203.0.113.9"}', module="trap", secs=0, batch=0):
    return (kind, module, batch, T0 + dt.timedelta(seconds=secs), seq, fp, "tgt", "trap.trip", severity, title, "fix it", evidence)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_lines_and_round_trip(spark):
    df = frame(
        spark, alert(0, severity="critical"), alert(1, kind="resolved"), alert(2, evidence='{"actor":"host-a","ip":7}'),
        alert(3, title="a\nb\r\0c"), alert(4, title="x" * 3000), alert(5, evidence='{"src":" 10.0.0.1 ","source_ip":5}'), alert(6, evidence=None))
    lines = [r.value for r in notify.alert_lines(df, "sentinel", "", 9).orderBy("seq").collect()]
    assert lines[0] == ("<130>Aug 19 13:52:01 sentinel trap[9]: Bait | product=trap severity=critical check=trap.trip "
                        "target=tgt status=open src=203.0.113.9")
    assert lines[1].startswith("<133>") and "RESOLVED: Bait" in lines[1] and "status=resolved" in lines[1]
    assert "src=" not in lines[2] and "src=" not in lines[6] and lines[5].endswith("src=10.0.0.1")
    assert "\n" not in lines[3] and "a b  c" in lines[3]
    assert lines[4].endswith("…") and len(lines[4].encode()) < 1700
    back = parse_syslog(spark.createDataFrame([(v, T0, i, "n") for i, v in enumerate(lines)], "value string, recv_ts timestamp, seq bigint, source_id string"))
    first = back.where("seq = 0").first()
    assert (first.src_ip, first.app, first.parsed, first.severity) == ("203.0.113.9", "trap", True, 2)


def test_digests(spark):
    rows = [alert(0, "a", severity="low"), alert(1, "b", severity="critical"), alert(2, "b", severity="critical"),
            alert(3, "c", kind="resolved", severity="info"), alert(4, "d", module="emberwatch", severity="high")]
    kept = notify.passes(frame(spark, *rows), "medium")
    d = notify.digests(kept).where("module = 'trap'").first()
    assert ([f.severity for f in d.opened], len(d.resolved)) == (["critical"], 1)
    d = notify.digests(frame(spark, *rows)).where("module = 'trap'")
    text = d.select(notify.digest_text(F.col("opened"), F.col("resolved"), F.col("module"), {"trap": "Trap"})).first()[0]
    assert text == ("Trap — 2 new finding(s)\n\n🟥 CRITICAL tgt\n  Bait\n  → fix it\n\n🟦 LOW tgt\n  Bait\n  → fix it\n\n"
                    "✅ 1 finding(s) resolved\n  • tgt — Bait")
    doc = json.loads(notify.webhook_json(d).first().value)
    assert doc["version"] == 1 and doc["at"] == "2026-08-19T13:52:01Z" and doc["opened"][0]["evidence"] == {"source_ip": "203.0.113.9"}
    only = json.loads(notify.webhook_json(notify.digests(frame(spark, alert(0)))).first().value)
    assert "resolved" not in only
    assert json.loads(notify.chat_json(d, {"trap": "Trap"}).first().value) == {"text": text}


def simulate(rows, seconds, limit):
    out, start = {}, None
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        if start is None or (r[3] - start).total_seconds() >= seconds:
            start, first, seen = r[3], r[4], set()
        key = (r[0], r[1], r[5])
        if key not in seen:
            out[r[4]] = first
        seen.add(key)
        if len(seen) >= limit:
            start = None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_match_simulation(spark, seed):
    rng = random.Random(seed)
    rows = [alert(i, f"f{rng.randrange(15)}", rng.choice(["opened", "resolved"]), module=rng.choice(["a", "b"]),
                  secs=rng.randrange(60) + rng.choice([0, 100, 130, 1000])) for i in range(300)]
    got = batching.replay(frame(spark, *rows).drop("batch"), 30, 8)
    assert {r.seq: r.batch for r in got.collect()} == simulate(rows, 30, 8)


@pytest.mark.parametrize("seed, seconds, limit, chunk", [(3, 30, 8, 7), (4, 10_000, 5, 16), (5, 3, 50, 5), (6, 200, 12, 400), (7, 100_000, 100, 9)])
def test_alerts_without_a_pause_are_cut_into_chunks(spark, seed, seconds, limit, chunk):
    """One long stretch over many chunks, with batches inside a chunk, over its end and longer than it."""
    rng = random.Random(seed)
    secs = sorted(rng.randrange(1000) / 2 for _ in range(400))
    rows = [alert(i, rng.choice(["f1", f"f{rng.randrange(40)}", None]), rng.choice(["opened", None]), module=rng.choice(["a", "b"]), secs=s) for i, s in enumerate(secs)]
    got = batching.replay(frame(spark, *rows).drop("batch"), seconds, limit, chunk).collect()
    assert len(got) == len({r.seq for r in got}) and {r.seq: r.batch for r in got} == simulate(rows, seconds, limit)


def test_batches_of_no_alerts(spark):
    empty = batching.replay(frame(spark, alert(0)).drop("batch").where("seq > 0"), 30, 8)
    assert empty.count() == 0 and empty.columns[-1] == "batch"


def test_domains(spark):
    df = spark.createDataFrame([("HTTPS://Example.com:443/path",), ("example.com.",), (" a.b/c?x#y ",), ("http://[::1]:80/",)], "d string")
    assert [r[0] for r in df.select(verify.normalize_domain(F.col("d"))).collect()] == ["example.com", "example.com", "a.b", "[::1]:80"]
    ch = spark.createDataFrame([("a.com", "1", "pending"), ("b.com", "2", "pending"), ("c.com", "3", "verified"), ("d.com", "4", "pending")],
                               "domain string, token string, state string")
    txt = spark.createDataFrame([("_sentinel-verify.a.com", " sentinel-verify=1 "), ("_sentinel-verify.a.com", "x"), ("_sentinel-verify.b.com", "sentinel-verify=9")], "name string, value string")
    web = spark.createDataFrame([("http://b.com/.well-known/sentinel-verify.txt", "sentinel-verify=2\n"), ("http://a.com/.well-known/sentinel-verify.txt", "sentinel-verify=1")], "url string, body string")
    out = {r.domain: (r.verified, r.method) for r in verify.verify_challenges(ch, txt, web).collect()}
    assert out == {"a.com": (True, "dns"), "b.com": (True, "http"), "c.com": (False, ""), "d.com": (False, "")}
    assert verify.pending(ch).count() == 3
