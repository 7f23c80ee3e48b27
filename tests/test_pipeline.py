import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from emberwatch.model import ChainConfig, DetectConfig, RECORD_SCHEMA, SOURCE_SCHEMA, STATE_SCHEMA
from emberwatch.operators import notify, records as rec, views as read
from emberwatch.plans import online, pipeline
from emberwatch.plans.lineage import pin
from emberwatch.sources import lines, registry
from emberwatch.sources.snapshots import Snapshots
from emberwatch.streaming import jobs

NOW = dt.datetime(2026, 8, 17, 12, 0)


def attack_lines():
    out = [f"<4>Aug 17 11:00:{i:02d} web01 kernel: [UFW BLOCK] IN=eth0 SRC=203.0.113.9 DST=10.0.0.5 PROTO=TCP DPT={20 + i}" for i in range(10)]
    out += [f"<38>Aug 17 11:01:{i:02d} web01 sshd[7]: Failed password for root from 203.0.113.9 port 5 ssh2" for i in range(8)]
    return out + ["<38>Aug 17 11:02:00 web01 sshd[7]: Accepted password for root from 203.0.113.9 port 5 ssh2"]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    (folder / "a.log").write_text("\n".join(attack_lines()) + "\n")
    found = lines.read_lines(spark, str(folder), "net", "syslog", received=F.lit(NOW))
    return pin(lines.parse_source(found, "syslog"))


def test_raw_lines_to_incident_and_back_to_resolved(spark, events):
    out = pipeline.immediate(events, DetectConfig(), ChainConfig())
    rows = {r.check: r for r in out.detections.collect()}
    assert set(rows) == {"detect.scan", "detect.brute_force", "incident.killchain"}
    top = rows["incident.killchain"]
    assert (top.severity, top.actor, top["count"], top.target) == ("critical", "203.0.113.9", 3, "web01")
    assert top.title == "Likely intrusion from 203.0.113.9: scan → brute force → successful login"
    assert top.evidence == [
        "2026-08-17T11:00:09Z  [scan]  Port scan: 203.0.113.9 hit 10 distinct ports",
        "2026-08-17T11:01:07Z  [brute_force]  Brute force: 8 failed logins from 203.0.113.9",
        "2026-08-17T11:02:00Z  [success]  successful login as root on web01"]
    assert {r.status for r in out.findings.collect()} == {"open"} and out.alerts.count() == 3

    src = spark.createDataFrame([("net", "syslog", {"udp": ":514"}, True, NOW)], SOURCE_SCHEMA)
    at = lambda h, m: F.lit(dt.datetime(2026, 8, 17, h, m)).cast("timestamp")
    still = pipeline.backstop(out.detections, src, rec.parse_rates(events), out.findings, at(11, 20))
    assert still.newly_open.count() == 0 and still.resolved.count() == 0
    quiet = pipeline.backstop(out.detections, src, None, still.state, at(13, 0))
    assert quiet.resolved.count() == 3
    note = pipeline.transition_alerts(quiet, at(13, 0))
    assert {r.kind for r in note.collect()} == {"resolved"}
    assert {r.status for r in read.findings_view(quiet.state, at(13, 5)).collect()} == {"resolved"}
    gone = pipeline.backstop(out.detections, src.where("false"), None, out.findings, at(11, 20),
                             scanned=spark.createDataFrame([("net",)], "target string"))
    assert gone.resolved.count() == 3


def test_sources_and_registry(spark, events, tmp_path):
    (tmp_path / "j.log").write_text("Failed password for bob\nsession x\ry opened\n")
    landed = str(tmp_path / "j.log")
    unit = registry.build_source(spark, "j", "journald", {"unit": "ssh.service"}, F.lit(NOW), landed)
    assert [(r.user, r.source, r.source_id, r.seq) for r in unit.orderBy("seq").collect()] == [("bob", "journald", "j", 0), ("", "journald", "j", 1)]
    for kind, params in (("syslog", {"udp": ":514"}), ("windows", {"tcp": ":514"}), ("file", {"path": landed})):
        assert registry.build_source(spark, "s", kind, params, F.lit(NOW), None if kind == "file" else landed).count() == 2
    with pytest.raises(ValueError):
        registry.build_source(spark, "s", "syslog", {"udp": ":514"})
    ctr = registry.build_source(spark, "c", "docker", {"container": "web"}, F.lit(NOW), landed)
    assert {r.app for r in ctr.collect()} == {"web"}
    merged = lines.fan_in({"x": events.withColumn("source_id", F.lit("")), "c": ctr})
    assert {r.source_id: r["count"] for r in merged.groupBy("source_id").count().collect()} == {"x": 19, "c": 2}
    assert merged.select("seq").distinct().count() == 21
    requests = spark.createDataFrame(
        [(" a ", "syslog", {"udp": ":1"}, 0), ("b", "file", {}, 1), ("", "file", {"path": "/x"}, 2), ("d", "docker", {"container": "c"}, 3),
         ("j", "journald", {}, 4), ("k", "ftp", {}, 5), ("w", "windows", {"tcp": ""}, 6)],
        "name string, type string, params map<string,string>, seq bigint")
    none = spark.createDataFrame([], SOURCE_SCHEMA)
    first = registry.put_sources(none, requests, F.lit(NOW).cast("timestamp"), limit=2)
    assert sorted(r.name for r in first.sources.collect()) == ["a", "d"]
    assert {r.name: r.error[:12] for r in first.refused.collect()} == {
        "b": "file: give i", "": "the name is ", "j": "no room for ", "k": "no such type", "w": "windows: giv"}
    later = registry.put_sources(first.sources, requests.where("seq = 0").withColumn("type", F.lit("windows")),
                                 F.lit(NOW + dt.timedelta(days=1)).cast("timestamp"))
    row = later.sources.where("name = 'a'").first()
    assert (row.type, row.created_at) == ("windows", NOW)


def test_snapshots_and_sinks(spark, events, tmp_path):
    out = pipeline.fired_records(events, DetectConfig(), ChainConfig())
    out.coalesce(1).write.parquet(str(tmp_path / "records"))
    dets, finds = Snapshots(spark, str(tmp_path / "det")), Snapshots(spark, str(tmp_path / "fin"))
    assert dets.version() == 0 and dets.read(RECORD_SCHEMA).count() == 0
    stream = spark.readStream.schema(RECORD_SCHEMA).parquet(str(tmp_path / "records"))
    jobs.record_sink(stream, dets, finds, str(tmp_path / "ck1"), availableNow=True).awaitTermination(120)
    assert dets.version() == 1 and dets.read(RECORD_SCHEMA).count() == 3 and finds.read(STATE_SCHEMA).count() == 3
    src = spark.createDataFrame([("net", "syslog", {"udp": ":514"}, True, NOW)], SOURCE_SCHEMA)
    later = F.lit(dt.datetime(2026, 8, 17, 14)).cast("timestamp")
    done = jobs.backstop_round(dets.read(RECORD_SCHEMA), src, None, finds, later)
    assert done.version == 2 and done.alerts.count() == 3 and {r.kind for r in done.alerts.collect()} == {"resolved"}
    assert {r.status for r in finds.read(STATE_SCHEMA).collect()} == {"resolved"}
    # a batch after the backstop sees the backstop's version, and a replay of it changes nothing
    first = spark.read.schema(RECORD_SCHEMA).parquet(str(tmp_path / "records")).limit(1)
    more = first.withColumn("key", F.lit("brute|other")).withColumn("title", F.lit("another"))
    more.write.mode("append").parquet(str(tmp_path / "records"))
    jobs.record_sink(stream, dets, finds, str(tmp_path / "ck1"), availableNow=True).awaitTermination(120)
    assert finds.version() == 3 and sorted(r.status for r in finds.read(STATE_SCHEMA).collect()) == ["open", "resolved", "resolved", "resolved"]
    finds.update(STATE_SCHEMA, lambda old: old.limit(0), next(iter(finds._commit_of(3)["applied"])), 1)
    assert finds.version() == 3 and finds.read(STATE_SCHEMA).count() == 4
    assert finds.read(STATE_SCHEMA, 1).count() == 3  # older versions stay readable


def test_lines_are_numbered_by_file_time_and_place(spark, tmp_path):
    for i, (name, n) in enumerate((("b.log", 3), ("a.log", 2000), ("c.log", 1))):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(n)))
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    rows = lines.read_lines(spark, str(tmp_path), "s").orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(2004))
    assert [r.value for r in rows] == [f"{n} {k}" for n, c in (("b.log", 3), ("a.log", 2000), ("c.log", 1)) for k in range(c)]


def test_many_alerts_of_one_trigger_become_bounded_batches(spark, events, tmp_path):
    base = pipeline.immediate(events, DetectConfig(), ChainConfig()).alerts.limit(1)
    many = base.crossJoin(spark.range(500)).withColumn("fingerprint", F.col("id").cast("string")).withColumn("seq", F.col("id")).drop("id")
    kept = notify.assign_batches(many)
    assert sorted(r["count"] for r in kept.groupBy("batch").count().collect()) == [100] * 5
    assert max(r.n for r in notify.digests(kept).select(F.size("opened").alias("n")).collect()) == 100


def test_snapshot_writers_do_not_overwrite_each_other(spark, tmp_path):
    table, other = Snapshots(spark, str(tmp_path / "t")), Snapshots(spark, str(tmp_path / "t"))
    add = lambda x: lambda old: old.unionByName(spark.createDataFrame([(x,)], "x int"))
    table.update("x int", add(1))

    def late(old):
        if table.version() == 1:
            other.update("x int", add(2))  # somebody else commits meanwhile
        return add(3)(old)

    assert table.update("x int", late) == 3
    assert sorted(r.x for r in table.read("x int").collect()) == [1, 2, 3]


def test_alert_sink_writes_lines_webhooks_and_chat(spark, events, tmp_path):
    alerts = pipeline.immediate(events, DetectConfig(), ChainConfig()).alerts
    alerts.coalesce(1).write.parquet(str(tmp_path / "alerts"))
    feed = spark.readStream.schema(alerts.schema).parquet(str(tmp_path / "alerts"))
    jobs.alert_sink(feed, str(tmp_path / "out"), str(tmp_path / "ck2"), minimum="high", host="h", availableNow=True).awaitTermination(120)

    def written(what):
        return "".join(open(f).read() for f in glob.glob(str(tmp_path / f"out/{what}/batch=0/part-*"))).splitlines()

    lines_out = written("lines")
    assert len(lines_out) == 2 and any("severity=critical" in x for x in lines_out) and all("src=203.0.113.9" in x for x in lines_out)
    assert "CRITICAL" in "".join(written("chat"))
    hooks = [json.loads(x) for x in written("webhook")]
    opened = [f for h in hooks for f in h["opened"]]
    assert sorted(f["severity"] for f in opened) == ["critical", "high"] and all(h["version"] == 1 and "resolved" not in h for h in hooks)
    assert all(f["title"] and f["remediation"] and f["evidence"]["actor"] == "203.0.113.9" for f in opened)


def test_stream_of_files_parses_like_batch(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    (folder / "a.log").write_text("\n".join(attack_lines()) + "\n")
    stream = lines.parse_source(lines.stream_lines(spark, str(folder), "net", "syslog", received=F.lit(NOW)), "syslog")
    q = (stream.writeStream.format("memory").queryName("parsed_lines").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.table("parsed_lines").groupBy("auth").count().where("auth = 'failure'").first()["count"] == 8


def test_equal_lines_of_a_streamed_file_differ(spark, tmp_path):
    folder = tmp_path / "in"
    os.makedirs(folder)
    repeated = ["same", "same", "other", "same"] * 700
    (folder / "a.log").write_text("\n".join(repeated) + "\n")
    (folder / "b.log").write_text("same\nsame\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # several stretches
    q = (lines.stream_lines(spark, str(folder), "net").writeStream.format("memory").queryName("placed_lines")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = spark.table("placed_lines").orderBy("seq").collect()
    files = {}
    for r in rows:
        files.setdefault(r.seq >> 32, []).append(r.value)
    assert sorted(files.values(), key=len) == [["same", "same"], repeated] and len({r.seq for r in rows}) == len(rows)
    batch = lines.read_lines(spark, str(folder / "a.log"), "net").orderBy("seq").collect()
    assert [r.value for r in batch] == repeated


def test_small_batches_leave_a_small_table(spark, tmp_path):
    schema = "k string, n bigint"
    table = Snapshots(spark, str(tmp_path / "t"), ("k",), buckets=32, keep=3, hold_s=0)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    add = lambda new: lambda old: old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))
    table.update(schema, add(frame([(f"k{i}", 1) for i in range(2000)])))
    want = {f"k{i}": 1 for i in range(2000)}
    for batch in range(12):
        new = frame([(f"k{batch}", 10), (f"new{batch}", 5)])
        before = set(table._commit_of(table.version())["folders"].values())
        table.update(schema, add(new), "s", batch, touched=new)
        assert len(set(table._commit_of(table.version())["folders"].values()) - before) <= 2  # of 32 buckets
        want[f"k{batch}"], want[f"new{batch}"] = 11, 5
    assert {r.k: r.n for r in table.read(schema).collect()} == want
    assert table.update(schema, add(frame([("k0", 99)])), "s", 11) == 13  # a replay
    assert sorted(os.listdir(tmp_path / "t/commits"))[-3:] and len([n for n in os.listdir(tmp_path / "t/commits") if n.isdigit()]) == 3
    named = {f for v in table._versions() for f in table._commit_of(v)["folders"].values()}
    assert {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").glob("v=*/_bucket=*")} == named
    with pytest.raises(ValueError):
        table.update(schema, lambda old: old.unionByName(frame([(f"x{i}", 1) for i in range(100)])), touched=frame([("x0", 1)]))
    assert table.read(schema, table.version() - 1).count() == 2011  # the versions kept stay readable


def test_lines_to_alerts_to_resolved_without_a_hand(spark, tmp_path):
    logs = tmp_path / "logs"
    os.makedirs(logs)
    later = lambda h: [f"<38>Aug 17 {h}:00:{i:02d} web09 cron[1]: Failed password for nobody from 198.51.100.{h} port 5 ssh2" for i in range(2)]
    for i, chunk in enumerate((attack_lines()[::-1], later(12), later(14))):
        (logs / f"{i}.log").write_text("\n".join(chunk) + "\n")
        os.utime(logs / f"{i}.log", (10_000 + i, 10_000 + i))
    landed = lines.stream_lines(spark, str(logs), "net", "syslog", received=F.lit(NOW), max_files=1)
    events = lines.parse_source(landed, "syslog")
    clock = str(tmp_path / "clock")
    for t in (dt.datetime(2026, 8, 17, 11, 20), dt.datetime(2026, 8, 17, 15, 0)):
        spark.createDataFrame([(t,)], "timestamp timestamp").coalesce(1).write.mode("append").parquet(clock)
    ticks = spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", 1).parquet(clock)
    src = spark.createDataFrame([("net", "syslog", {"udp": ":514"}, True, NOW)], SOURCE_SCHEMA)
    path = online.Online(spark, str(tmp_path / "on"), DetectConfig(), ChainConfig(), delay_s=30, trigger={"availableNow": True})
    for q in path.start(events, ticks, lambda: src, host="h"):
        assert q.exception() is None
    batch = lines.parse_source(lines.read_lines(spark, str(logs), "net", "syslog", received=F.lit(NOW)), "syslog")
    want = pipeline.immediate(pin(batch), DetectConfig(), ChainConfig())
    shown = lambda df: sorted((r.check, r.severity, r.title, r.detail, r["count"], tuple(r.evidence)) for r in df.collect())
    assert shown(path.detections.read(RECORD_SCHEMA, 1)) == shown(want.detections) and want.detections.count() == 3
    state = path.findings.read(STATE_SCHEMA).collect()
    assert len(state) == 3 and {r.status for r in state} == {"resolved"}
    assert path.detections.read(RECORD_SCHEMA).count() == 0  # older than an hour by the second tick

    def written(what):
        return "".join(open(f).read() for f in glob.glob(str(tmp_path / f"on/out/{what}/lines/*/part-*"))).splitlines()

    assert len(written("opened")) == 3 and all("status=open" in x for x in written("opened"))
    assert len(written("rounds")) == 3 and all("RESOLVED" in x for x in written("rounds"))
