import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from emberwatch.model import EVENT_SCHEMA, ChainConfig, DetectConfig
from emberwatch.operators import correlate, detectors, records
from emberwatch.streaming import detect as online
from emberwatch.streaming.ordered import LateRows, use_rocksdb

from test_detect import EPOCH, event, events_df, random_events

CFG = DetectConfig(brute_failures=4, brute_window_s=20, scan_ports=5, scan_window_s=30, exfil_bytes=1_000_000,
                   exfil_factor=2.0, exfil_window_s=10, spike_min=6, spike_window_s=15, cooldown_s=60, evidence_max=3)


def replay(spark, tmp_path, stream, name):
    q = (stream.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path / f"ck_{name}")).trigger(availableNow=True).start())
    q.awaitTermination(240)
    assert q.exception() is None
    return spark.table(name)


def landed(spark, tmp_path, rows, parts=3):
    """The events as files, in shuffled order inside each, followed by far later rows that move the watermark."""
    rows = sorted(rows, key=lambda r: r["us"])
    step = len(rows) // parts + 1
    late = [event(4_000_000_000 + i, 10**6 + i, auth="failure", src_ip="0.0.0.9", dst_port=9, bytes_out=1, host="zz",
                  action="new_admin", message="product=x severity=high") for i in range(2)]
    chunks = [rows[i : i + step][::-1] for i in range(0, len(rows), step)] + [late[:1], late[1:]]
    folder = str(tmp_path / "events")
    for i, chunk in enumerate(chunks):
        events_df(spark, chunk).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(folder)


def rows_of(df):
    shown = df.where("seq < 1000000").select(*[F.unix_micros(c).alias(c) if c in ("first_at", "last_at") else c for c in detectors.DETECTION_COLUMNS])
    return sorted(map(str, shown.collect()))


@pytest.mark.parametrize("kind", ["brute_force", "scan", "exfil", "auth_spike", "sentinel_finding", "new_admin"])
def test_stream_equals_batch(spark, tmp_path, kind):
    use_rocksdb(spark)
    rows = random_events(21, n=300, span_s=600)
    for r in rows:
        if r["seq"] % 5 == 0:
            r["message"] = "x | product=trap severity=high check=a status=open"
        elif r["seq"] % 5 == 1:
            r["message"] = "x | product=rules severity=critical status=open"
    stream = online.described(online.STREAM_DETECTORS[kind](landed(spark, tmp_path, rows), CFG, "700 seconds"), kind, CFG)
    got = rows_of(replay(spark, tmp_path, stream, f"s_{kind}"))
    assert got and got == rows_of(detectors.DETECTORS[kind](events_df(spark, rows), CFG))


def landed_steps(spark, tmp_path, steps):
    folder = str(tmp_path / "steps")
    steps.coalesce(1).write.parquet(folder)
    for i in range(2):
        last = spark.createDataFrame([("zz", EPOCH + dt.timedelta(days=1, seconds=i), 10**6 + i, 7, "success", "", "", "", "", "")], steps.schema)
        last.write.mode("append").parquet(folder)
    return spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("chain", [ChainConfig(100, 150), ChainConfig(200, 30)])
def test_incidents_of_the_stream_are_full_records(spark, tmp_path, chain):
    use_rocksdb(spark)
    rows = random_events(3, n=400, span_s=2400)
    for r in rows:
        if r["seq"] % 7 == 0:
            r["message"] = "x | product=trap severity=high check=a status=open"
    cfg = DetectConfig(brute_failures=3, brute_window_s=60, scan_ports=4, scan_window_s=60, cooldown_s=90)
    ev = events_df(spark, rows)
    dets = detectors.detect_all(ev, cfg, {k: detectors.DETECTORS[k] for k in ("brute_force", "scan", "sentinel_finding")}).persist()
    stream = online.incidents(landed_steps(spark, tmp_path, online.login_steps(ev).unionByName(online.detection_steps(dets))), chain, "10 seconds")
    name = f"chain_{chain.window_s}"
    got = records.incident_records(replay(spark, tmp_path, stream, name))
    want = records.incident_records(correlate.incidents(ev, dets, chain))
    shown = lambda df: sorted(map(str, df.where("seq < 1000000").collect()))
    assert {s for r in spark.table(name).collect() for s in r.stages} == {"scan", "brute_force", "success", "deception"}
    assert shown(got) == shown(want)
    dets.unpersist()


def test_many_rows_of_one_key_take_linear_time(spark, tmp_path):
    """20,000 rows of one address with as many ports, at a threshold that is never met and windows that overlap."""
    use_rocksdb(spark)
    cfg = DetectConfig(scan_ports=10**6, scan_window_s=3600, brute_failures=10**6, brute_window_s=3600)

    def took(n, kind):
        rows = [event(i * 1000, i, src_ip="9.9.9.1", dst_port=1 + i % 60_000, auth="failure") for i in range(n)]
        folder = tmp_path / f"{kind}{n}"
        folder.mkdir()
        stream = online.STREAM_DETECTORS[kind](landed(spark, folder, rows, parts=2), cfg, "10 seconds")
        start = time.time()
        assert replay(spark, folder, stream, f"{kind}_{n}").where("seq < 1000000").count() == 0
        return time.time() - start

    took(100, "scan")
    small, large = took(5_000, "scan"), took(20_000, "scan")
    assert large < 6 * small + 5


def test_silent_keys_are_forgotten_and_late_rows_counted(spark, tmp_path):
    use_rocksdb(spark)
    late = LateRows()
    spark.streams.addListener(late)
    seconds = lambda n: n * 1_000_000
    cfg = DetectConfig(exfil_bytes=10**9, brute_failures=50, cooldown_s=20, brute_window_s=20, exfil_window_s=20)
    early = [event(seconds(i), i, src_ip=f"9.9.0.{i}", host=f"h{i}", bytes_out=5, auth="failure", user="x",
                   message="product=x severity=high status=open") for i in range(30)]
    chunks = [early, [event(seconds(100), 100, src_ip="8.8.8.8", host="z")], [event(seconds(400), 101, src_ip="8.8.8.8", host="z", bytes_out=1, auth="failure", message="product=x severity=high")],
              [event(seconds(5), 102, src_ip="9.9.0.1", host="h1", bytes_out=5, auth="failure", message="product=x severity=high"),
               event(seconds(800), 103, src_ip="8.8.8.8", host="z", bytes_out=1, auth="failure", message="product=x severity=high")]]
    folder = str(tmp_path / "ttl")
    for chunk in chunks:
        events_df(spark, chunk).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.1)
    feed = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    for kind in ("brute_force", "exfil", "sentinel_finding"):
        stream = online.STREAM_DETECTORS[kind](feed, cfg, "10 seconds", ttl_s=60)
        checkpoint = str(tmp_path / f"ck_{kind}")
        q = (stream.writeStream.format("memory").queryName(f"ttl_{kind}").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination(240)
        stories = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "story").load()
        assert stories.count() <= 1, kind  # only the key that is still heard of
        deadline = time.time() + 20
        while late.dropped.get(f"ttl_{kind}", 0) < 1 and time.time() < deadline:
            time.sleep(0.2)
        assert late.dropped[f"ttl_{kind}"] == 1
    spark.streams.removeListener(late)
