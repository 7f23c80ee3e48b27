"""Named queries over the test tables, one per operator family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from emberwatch.functions import fields, findings as fn, net, syslog, text
from emberwatch.model import FINDING_SCHEMA, STATE_SCHEMA, ChainConfig, DetectConfig, columns
from emberwatch.operators import correlate, detectors, notify, reconcile, records as rec, thinning, verify, views as read, windows as win
from emberwatch.plans import views
from emberwatch.plans.lineage import pin
from emberwatch.sources import lines, registry

DAY = 86_400
CFG = DetectConfig(
    brute_failures=3, brute_window_s=DAY, scan_ports=6, scan_window_s=DAY, exfil_window_s=3600,
    spike_min=6, spike_window_s=3 * DAY, cooldown_s=5 * DAY,
)
CHAIN = ChainConfig(3 * DAY, 6 * DAY)
US = 1_000_000
NAMES = {"trap": "Trap"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def us(name: str) -> Column:
    return F.unix_micros(name)


def stored_events(spark, sf_dir, view=views.events) -> DataFrame:
    """The events as a written table, for queries that scan them many times."""
    return pin(view(spark, sf_dir))


def keyed(spark, sf_dir, key: str) -> DataFrame:
    return win.micros(views.events(spark, sf_dir)).withColumn("k", F.col(key))


# --- parsing -------------------------------------------------------------------------------------

def event_row(df: DataFrame) -> DataFrame:
    return df.select("seq", us("ts").alias("us"), "source", "source_id", "host", "app", "severity", "message", "auth",
                     "user", "src_ip", "dst_port", "bytes_out", "action", "parsed")


@query
def parse_syslog(spark, sf_dir):
    return event_row(syslog.parse_syslog(views.raw_lines(spark, sf_dir)))


@query
def parse_windows_source(spark, sf_dir):
    return event_row(lines.parse_source(views.raw_lines(spark, sf_dir), "windows"))


@query
def parse_lines(spark, sf_dir):
    plain = F.regexp_replace("value", "^<[0-9]+>", "")
    return event_row(syslog.parse_lines(
        views.raw_lines(spark, sf_dir).withColumns({"value": plain, "source": F.lit("docker"), "app": F.lit("ctr")})))


@query
def fan_in(spark, sf_dir):
    raw = views.raw_lines(spark, sf_dir)
    framed = syslog.parse_syslog(raw.where("seq % 2 = 0")).withColumn("source_id", F.lit(""))
    plain = syslog.parse_lines(raw.where("seq % 2 = 1"))
    out = lines.fan_in({"net": framed, "disk": plain})
    return out.groupBy("source_id", "auth", "action", "parsed").agg(F.count(F.lit(1)).alias("n"))


def document_events(spark, sf_dir) -> DataFrame:
    docs = views.load(spark, sf_dir, "documents")
    return syslog.parse_lines(docs.select(
        F.col("text").alias("value"), F.timestamp_seconds(F.lit(1706745600)).alias("recv_ts"), F.col("doc_id").alias("seq"),
        F.lit("file").alias("source"), F.lit("docs").alias("source_id"), F.lit("").alias("host"), F.lit("").alias("app")))


@query
def src_ip_documents(spark, sf_dir):
    return document_events(spark, sf_dir).select(F.col("seq").alias("doc_id"), "src_ip", "user", "dst_port", "bytes_out")


@query
def auth_classify(spark, sf_dir):
    return document_events(spark, sf_dir).select(F.col("seq").alias("doc_id"), "auth", "action")


@query
def is_ip_documents(spark, sf_dir):
    words = views.load(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n]+")).alias("w"))
    out = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return out.select("w", "n", net.is_ip(F.col("w")).alias("ip"), net.is_private_ip(F.col("w")).alias("private"))


@query
def actor(spark, sf_dir):
    e = views.events(spark, sf_dir)
    who = fields.actor(F.when(F.col("seq") % 3 == 0, F.col("src_ip")).otherwise(""), F.when(F.col("seq") % 3 == 1, F.col("user")).otherwise(""), F.col("host"))
    return e.groupBy(who.alias("actor")).agg(F.count(F.lit(1)).alias("n"))


@query
def human_bytes(spark, sf_dir):
    return views.events(spark, sf_dir).select("seq", text.human_bytes(F.col("bytes_out") * F.pow(F.lit(7), F.col("seq") % 8).cast("bigint")).alias("size"))


@query
def forwarded_tokens(spark, sf_dir):
    m = F.col("message")
    return views.forwarded(spark, sf_dir).groupBy(*[fields.token(m, t).alias(t) for t in ("product", "severity", "check", "status")]).agg(F.count(F.lit(1)).alias("n"))


# --- sliding windows -----------------------------------------------------------------------------

@query
def rolling_count(spark, sf_dir):
    return win.rolling_count(keyed(spark, sf_dir, "user").select("k", "us", "seq"), "k", DAY * US)


@query
def rolling_distinct(spark, sf_dir):
    return win.rolling_distinct(keyed(spark, sf_dir, "host").select("k", "us", "seq", "src_ip"), "k", "src_ip", DAY * US).select("k", "us", "seq", "n")


@query
def rolling_sum(spark, sf_dir):
    return win.rolling_sum(keyed(spark, sf_dir, "host").select("k", "us", "seq", "bytes_out"), "k", "bytes_out", 3600 * US).select("k", "us", "seq", "total")


@query
def cooldown(spark, sf_dir):
    cands = keyed(spark, sf_dir, "user").groupBy("k", "us").agg(F.min("seq").alias("seq"))
    return thinning.thin(cands, "k", 2 * DAY * US)


@query
def cooldown_dense(spark, sf_dir):
    """Every event of a host is a candidate and the cooldown is short: long sessions, many fires."""
    cands = keyed(spark, sf_dir, "host").groupBy("k", "us").agg(F.min("seq").alias("seq"))
    return thinning.thin(cands, "k", 3600 * US)


@query
def ewma_baseline(spark, sf_dir):
    _, totals = detectors.egress_totals(views.events(spark, sf_dir), CFG.exfil_window_s)
    whole = lambda c: F.round(F.col(c) / 1000).cast("bigint").alias(c)
    return totals.select("k", "us", "seq", "total", whole("base_before"), whole("base_after"))


def one_key(spark, sf_dir) -> DataFrame:
    """All events under one key, many to a window."""
    return win.micros(views.events(spark, sf_dir)).select(F.lit("all").alias("k"), "us", "seq", "bytes_out", "src_ip")


@query
def rolling_hot(spark, sf_dir):
    """Count, sum and distinct addresses of the last day over one key that holds every row."""
    counted = win.rolling_sum(win.rolling_count(one_key(spark, sf_dir), "k", DAY * US), "k", "bytes_out", DAY * US)
    return win.rolling_distinct(counted, "k", "src_ip", DAY * US, "addresses").select("k", "us", "seq", "n", "total", "addresses")


@query
def ewma_hot(spark, sf_dir):
    """The baseline over one key that holds every row, to seven significant digits."""
    digits = lambda c: F.format_string("%.6e", c).alias(c)
    return win.ewma(one_key(spark, sf_dir), "k", "bytes_out").select("k", "us", "seq", digits("base_before"), digits("base_after"))


# --- detectors and incidents ---------------------------------------------------------------------

def detection_row(df: DataFrame) -> DataFrame:
    return df.select("kind", "severity", "actor", "target", "user", "title", "detail", "count", us("first_at").alias("first_us"),
                     us("last_at").alias("last_us"), F.array_join("evidence", "|").alias("evidence"), "key", "source_id", "ord")


def _detector(name: str, kind: str, source) -> None:
    def run(spark, sf_dir):
        return detection_row(detectors.DETECTORS[kind](source(spark, sf_dir), CFG))
    QUERIES[name] = run


_detector("brute_force", "brute_force", stored_events)
_detector("port_scan", "scan", stored_events)
_detector("exfil", "exfil", stored_events)
_detector("new_admin", "new_admin", views.events)
_detector("auth_spike", "auth_spike", stored_events)
_detector("forwarded_finding", "sentinel_finding", views.forwarded)


# A cooldown shorter than the windows: every fire starts its window anew.
SHORT = replace(CFG, brute_failures=2, brute_window_s=4 * DAY, scan_ports=4, scan_window_s=4 * DAY, cooldown_s=DAY // 2)


# Detections soon again, so that an actor has many stages to use up.
REPEATED = replace(CFG, brute_failures=2, brute_window_s=DAY, scan_ports=3, cooldown_s=DAY + 1)


def fire_row(df: DataFrame) -> DataFrame:
    return df.select("actor", us("last_at").alias("us"), "seq", "count")


@query
def brute_force_short_cooldown(spark, sf_dir):
    return fire_row(detectors.brute_force(stored_events(spark, sf_dir), SHORT))


@query
def port_scan_short_cooldown(spark, sf_dir):
    return fire_row(detectors.port_scan(stored_events(spark, sf_dir), SHORT))


@query
def auth_spike_short_cooldown(spark, sf_dir):
    return fire_row(detectors.auth_spike(stored_events(spark, sf_dir), replace(CFG, spike_min=4, cooldown_s=DAY // 2)))


@query
def detect_all(spark, sf_dir):
    """Every detection of all six kinds."""
    return detection_row(detectors.detect_all(stored_events(spark, sf_dir, views.mixed), CFG))


def chain_stages(ev: DataFrame, bait: Callable[[], DataFrame] | None = None, cfg: DetectConfig = CFG) -> DataFrame:
    """Detections that incidents rest on; ``bait`` makes the events with forwarded findings. The detectors run side by side."""
    runs = [(detectors.brute_force, lambda: ev), (detectors.port_scan, lambda: ev)]
    return pin(detectors.side_by_side(runs + ([(detectors.forwarded_finding, bait)] if bait else []), cfg))


def incident_row(df: DataFrame) -> DataFrame:
    return df.select("severity", "actor", "target", "title", "detail", F.array_join("stages", ">").alias("stages"),
                     us("first_at").alias("first_us"), us("last_at").alias("last_us"), "key", "source_id")


@query
def killchain_success(spark, sf_dir):
    ev = stored_events(spark, sf_dir)
    return incident_row(correlate.incidents(ev, chain_stages(ev), CHAIN))


@query
def killchain_deception(spark, sf_dir):
    ev, bait = stored_events(spark, sf_dir), stored_events(spark, sf_dir, views.forwarded)
    return incident_row(correlate.incidents(bait, chain_stages(ev, lambda: bait), CHAIN))


@query
def killchain_short_cooldown(spark, sf_dir):
    """Logins and bait mixed, with a cooldown inside the window: what an incident rests on is used up."""
    ev = stored_events(spark, sf_dir)
    dets = chain_stages(ev, lambda: stored_events(spark, sf_dir, views.forwarded), REPEATED)
    return incident_row(correlate.incidents(ev, dets, ChainConfig(3 * DAY, DAY // 4))).drop("title", "detail", "key")


@query
def incident_members(spark, sf_dir):
    ev = stored_events(spark, sf_dir)
    out = rec.incident_records(correlate.incidents(ev, chain_stages(ev), CHAIN))
    return out.select("source_id", "key", "check", "count", "fix", F.posexplode("evidence").alias("pos", "line"))


# --- records, findings, lifecycle ----------------------------------------------------------------

def record_row(df: DataFrame) -> DataFrame:
    return df.select("source_id", "key", "check", "severity", "actor", "target", "title", "detail",
                     F.array_join("evidence", "|").alias("evidence"), "fix", "count", us("first_at").alias("first_us"), us("last_at").alias("last_us"))


def halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    r = views.records(spark, sf_dir)
    old = F.col("last_at") < F.expr(views.SPLIT)
    return r.where(old), r.where(~old)


def table(spark, sf_dir) -> DataFrame:
    old, new = halves(spark, sf_dir)
    return rec.upsert_detections(rec.upsert_detections(None, old), new)


def state_before(spark, sf_dir) -> DataFrame:
    """Findings of the first half with a mix of statuses."""
    old, _ = halves(spark, sf_dir)
    s = rec.write_findings(None, old)
    n = F.pmod(us("last_seen"), F.lit(10))
    status = F.when(n < 2, "resolved").when(n == 2, "suppressed").when(n == 3, "acknowledged").otherwise("open")
    return s.withColumn("status", status).withColumn(
        "resolved_at", F.when(F.col("status") == "resolved", F.col("last_seen"))).withColumn(
        "absent_streak", F.when(n == 4, 1).otherwise(0))


def fresh_findings(spark, sf_dir) -> DataFrame:
    """Findings of the second half; some titles are blank and get refused."""
    _, new = halves(spark, sf_dir)
    return rec.findings(rec.upsert_detections(None, new)).select(*columns(FINDING_SCHEMA), "seq")


def state_row(df: DataFrame) -> DataFrame:
    times = ("first_seen", "last_seen", "resolved_at")
    return df.select(*[us(c).alias(c) if c in times else F.col(c) for c in columns(STATE_SCHEMA)])


def reconciled(spark, sf_dir) -> reconcile.Reconciled:
    scanned = views.load(spark, sf_dir, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("target")).where("target != 'src2'").distinct()
    fresh = fresh_findings(spark, sf_dir).where("target != 'src2'")
    return reconcile.reconcile(state_before(spark, sf_dir), fresh, scanned, F.expr(views.NOW), resolve_after=2)


@query
def parse_rate(spark, sf_dir):
    return rec.parse_rates(views.events(spark, sf_dir)).select("source_id", "lines", F.round("parse_rate", 6).alias("parse_rate"))


@query
def source_list(spark, sf_dir):
    seen = rec.parse_rates(views.events(spark, sf_dir).where("source_id != 'src1'"))
    return read.source_list(views.sources(spark, sf_dir), seen).select(
        "name", "type", F.element_at("params", "path").alias("path"), us("created_at").alias("created_at"), F.round("parse_rate", 6).alias("parse_rate"))


@query
def fingerprint(spark, sf_dir):
    r = views.records(spark, sf_dir)
    return r.select("seq", fn.fingerprint(F.lit("emberwatch"), F.col("source_id"), F.col("check"), F.col("key")).alias("fp"),
                    fn.sortable_id(F.col("last_at"), F.col("key")).alias("id"))


@query
def severity_rank(spark, sf_dir):
    r, s = views.records(spark, sf_dir), F.col("severity")
    return r.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select(
        "severity", "n", fn.severity_rank(s).alias("rank"), fn.severity_rank(s, 0).alias("alert_rank"), fn.is_severity(s).alias("valid"),
        notify.alert_priority(F.lit("opened"), s).alias("priority"))


@query
def upsert_detections(spark, sf_dir):
    return record_row(table(spark, sf_dir))


@query
def detection_finding(spark, sf_dir):
    return rec.findings(views.records(spark, sf_dir)).select(*columns(FINDING_SCHEMA), "seq")


@query
def finding_write(spark, sf_dir):
    _, new = halves(spark, sf_dir)
    return state_row(rec.write_findings(state_before(spark, sf_dir), new))


@query
def reconcile_state(spark, sf_dir):
    return state_row(reconciled(spark, sf_dir).state)


@query
def reconcile_newly_open(spark, sf_dir):
    return state_row(reconciled(spark, sf_dir).newly_open)


@query
def reconcile_resolved(spark, sf_dir):
    return state_row(reconciled(spark, sf_dir).resolved)


@query
def reconcile_rejected(spark, sf_dir):
    return reconciled(spark, sf_dir).rejected


@query
def evidence_cap(spark, sf_dir):
    docs = views.load(spark, sf_dir, "documents")
    doc = fn.compact_json(F.struct(F.repeat(F.col("source"), F.col("n_chars").cast("int")).alias("t")))
    capped = fn.cap_evidence(doc)
    return docs.select("doc_id", F.octet_length(capped).alias("bytes"), F.md5(capped).alias("digest"))


@query
def active_findings(spark, sf_dir):
    ev, src = views.events(spark, sf_dir), views.sources(spark, sf_dir)
    rates = rec.parse_rates(ev.where("dst_port < 80"))
    return rec.active_findings(table(spark, sf_dir), src, rates, F.expr(views.NOW), active_s=2 * DAY).drop("evidence")


@query
def set_status(spark, sf_dir):
    state = state_before(spark, sf_dir)
    return state_row(reconcile.set_status(state, status_changes(spark, sf_dir))[0])


def status_changes(spark, sf_dir) -> DataFrame:
    _, new = halves(spark, sf_dir)
    n = F.pmod(F.col("seq"), F.lit(4))
    to = F.when(n == 0, "acknowledged").when(n == 1, "suppressed").when(n == 2, "open").otherwise("resolved")
    return rec.findings(new).select("fingerprint", to.alias("status"), "seq")


@query
def set_status_refused(spark, sf_dir):
    return reconcile.set_status(state_before(spark, sf_dir), status_changes(spark, sf_dir))[1]


@query
def prune_detections(spark, sf_dir):
    return record_row(rec.prune_detections(table(spark, sf_dir), F.expr(f"{views.NOW} - interval 4 days")))


@query
def prune_resolved(spark, sf_dir):
    cutoff = reconcile.retention_cutoff(F.expr(views.NOW), 20)
    left, dropped = reconcile.prune_resolved(state_before(spark, sf_dir), cutoff)
    return left.groupBy("status").agg(F.count(F.lit(1)).alias("n")).unionByName(
        dropped.select(F.lit("(pruned)").alias("status"), F.col("pruned").alias("n")))


@query
def delete_source_cascade(spark, sf_dir):
    names = views.sources(spark, sf_dir).where("type in ('file', 'journald')").select("name")
    out = rec.delete_sources(views.sources(spark, sf_dir), table(spark, sf_dir), names)
    return out.sources.select(F.lit("source").alias("what"), "name").groupBy("what", "name").agg(F.count(F.lit(1)).alias("n")).unionByName(
        out.detections.groupBy(F.lit("detection").alias("what"), F.col("source_id").alias("name")).agg(F.count(F.lit(1)).alias("n")))


@query
def diff_findings(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    side = lambda r: rec.findings(rec.upsert_detections(None, r))
    return reconcile.diff_findings(side(old), side(new))


def source_requests(spark, sf_dir) -> DataFrame:
    """Requests to save a source, derived from ``pages``: odd names, kinds and parameters."""
    p, n = views.load(spark, sf_dir, "pages"), F.col("page_id")
    kinds = F.array(*[F.lit(t) for t in ("syslog", "file", "journald", "docker", "windows", "ftp")])
    params = F.map_from_arrays(
        F.array(F.element_at(F.array(*[F.lit(x) for x in ("udp", "path", "unit", "container", "tcp")]), (n % 5 + 1).cast("int"))),
        F.array(F.when(n % 7 == 0, "").otherwise(F.col("url"))))
    name = F.when(n % 11 == 0, "  ").otherwise(F.concat(F.lit(" p"), (n % 50).cast("string"), F.lit(" ")))
    return p.select(name.alias("name"), F.element_at(kinds, (n % 6 + 1).cast("int")).alias("type"), params.alias("params"), n.alias("seq"))


@query
def validate_sources(spark, sf_dir):
    return registry.validate_sources(source_requests(spark, sf_dir)).select("seq", "name", "type", "error")


@query
def put_sources(spark, sf_dir):
    requests = source_requests(spark, sf_dir).withColumn(
        "name", F.when(F.col("seq") % 13 == 0, F.concat(F.lit("src"), (F.col("seq") % 4).cast("string"))).otherwise(F.col("name")))
    saved = registry.put_sources(views.sources(spark, sf_dir), requests, F.expr(views.NOW), limit=20)
    return saved.sources.select(
        "name", "type", F.array_join(F.map_values("params"), ",").alias("value"), us("created_at").alias("created_at"), F.lit("kept").alias("what")
    ).unionByName(saved.refused.groupBy("name", "type", F.col("error").alias("what")).agg(F.count(F.lit(1)).alias("_n")).select(
        "name", "type", F.col("_n").cast("string").alias("value"), F.lit(None).cast("bigint").alias("created_at"), "what"))


# --- alerts --------------------------------------------------------------------------------------

def alerts(spark, sf_dir) -> DataFrame:
    """Opened and resolved findings of ``events`` as alerts, one batch per hour."""
    r = rec.findings(views.records(spark, sf_dir))
    return r.select(
        F.when(F.col("seq") % 5 == 0, "resolved").otherwise("opened").alias("kind"),
        F.when(F.col("seq") % 3 == 0, "trap").otherwise("emberwatch").alias("module"),
        F.floor(us("last_at") / (3600 * US)).alias("batch"), F.col("last_at").alias("at"), "seq",
        "fingerprint", *notify.ALERT_FIELDS)


@query
def alert_filter(spark, sf_dir):
    kept = notify.passes(alerts(spark, sf_dir), "high")
    return kept.groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def digest(spark, sf_dir):
    d = notify.digests(alerts(spark, sf_dir))
    order = lambda c: F.array_join(F.transform(c, lambda f: F.concat(f["severity"], F.lit(":"), f["title"])), "|").alias(c)
    return d.select("module", "batch", us("at").alias("at"), order("opened"), order("resolved"))


@query
def digest_text(spark, sf_dir):
    d = notify.digests(alerts(spark, sf_dir))
    return d.select("module", "batch", notify.digest_text(F.col("opened"), F.col("resolved"), F.col("module"), NAMES).alias("text"))


@query
def webhook_json(spark, sf_dir):
    item = "array<struct<target string, check string, title string>>"
    j = F.from_json("value", f"version int, module string, at string, opened {item}, resolved {item}")
    out, d = notify.webhook_json(notify.digests(alerts(spark, sf_dir))).withColumn("j", j), "|"
    titles = lambda c: F.array_join(F.transform(F.col("j")[c], lambda f: F.concat(f["target"], F.lit("/"), f["check"], F.lit("/"), f["title"])), d)
    return out.select("module", "batch", F.col("j.version").alias("version"), F.col("j.at").alias("at"), titles("opened").alias("opened"), titles("resolved").alias("resolved"))


@query
def chat_json(spark, sf_dir):
    return notify.chat_json(notify.digests(alerts(spark, sf_dir)), NAMES).select("module", "batch", F.get_json_object("value", "$.text").alias("text"))


@query
def alert_lines(spark, sf_dir):
    return notify.alert_lines(alerts(spark, sf_dir), host="collector", pid=7).select("seq", "value")


@query
def alert_lines_reparsed(spark, sf_dir):
    """Alert lines read back as syslog: the round trip between two installations."""
    sent = notify.alert_lines(alerts(spark, sf_dir), host="collector", pid=7)
    back = syslog.parse_syslog(sent.select("value", F.col("at").alias("recv_ts"), "seq", F.lit("net").alias("source_id")))
    m = F.col("message")
    return back.select("seq", us("ts").alias("us"), "host", "app", "severity", "src_ip", fields.token(m, "product").alias("product"),
                       fields.token(m, "severity").alias("level"), fields.token(m, "status").alias("status"))


@query
def sanitize_documents(spark, sf_dir):
    d = views.load(spark, sf_dir, "documents")
    s = notify.sanitize(F.col("text"))
    return d.select("doc_id", F.octet_length(s).alias("bytes"), F.md5(s).alias("digest"))


@query
def alert_batches(spark, sf_dir):
    a = alerts(spark, sf_dir).drop("batch")
    out = notify.assign_batches(a, seconds=6 * 3600, limit=40)
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


# --- read side and ownership ---------------------------------------------------------------------

@query
def open_counts(spark, sf_dir):
    return read.open_counts(state_before(spark, sf_dir))


@query
def summary(spark, sf_dir):
    s = read.summary(state_before(spark, sf_dir), views.sources(spark, sf_dir))
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return s.select("product", F.array_join(pairs, ",").alias("counts"), "open_total", "targets")


@query
def findings_view(spark, sf_dir):
    at = F.expr(f"{views.SPLIT} + interval 1 hour")
    return read.findings_view(state_before(spark, sf_dir), at, hide_suppressed=True, ranked=True).withColumns(
        {c: us(c) for c in ("first_seen", "last_seen")})


@query
def findings_list(spark, sf_dir):
    """The plain list, with suppressed findings."""
    at = F.expr(f"{views.SPLIT} + interval 1 hour")
    return read.findings_view(state_before(spark, sf_dir), at).withColumns({c: us(c) for c in ("first_seen", "last_seen")})


@query
def findings_of_target(spark, sf_dir):
    return read.findings_of(state_before(spark, sf_dir), target="src1").select("target", "fingerprint", "title", "status")


@query
def detections_of_source(spark, sf_dir):
    return record_row(read.detections_of(table(spark, sf_dir), "src1"))


@query
def incidents_view(spark, sf_dir):
    out = read.incidents_view(table(spark, sf_dir), views.sources(spark, sf_dir), F.expr(views.NOW), active_s=3 * DAY)
    return out.withColumn("evidence", F.array_join("evidence", "|"))


@query
def normalize_domain(spark, sf_dir):
    u = F.concat(F.when(F.col("page_id") % 3 == 0, F.upper("url")).otherwise(F.col("url")))
    ported = F.regexp_replace(u, r"(?i)\.(com|net|org)/", ".$1:8443/")
    return views.load(spark, sf_dir, "pages").select(
        "page_id", verify.normalize_domain(u).alias("domain"), verify.normalize_domain(F.concat(F.lit(" "), ported)).alias("ported"),
        verify.normalize_domain(F.concat(verify.normalize_domain(u), F.lit(". "))).alias("dotted"))


def challenges(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    p, n = views.load(spark, sf_dir, "pages"), F.col("page_id")
    domain = verify.normalize_domain(F.col("url"))
    asked = p.groupBy(domain.alias("domain")).agg(F.min(n).cast("string").alias("token")).withColumn("state", F.lit("pending"))
    txt = p.where(n % 2 == 0).select(F.concat(F.lit("_sentinel-verify."), domain).alias("name"), F.concat(F.lit(" sentinel-verify="), n.cast("string"), F.lit("\n")).alias("value"))
    web = p.where(n % 3 == 0).select(F.concat(F.lit("http://"), domain, F.lit("/.well-known/sentinel-verify.txt")).alias("url"), F.concat(F.lit("sentinel-verify="), n.cast("string")).alias("body"))
    return asked, txt, web


@query
def pending_challenges(spark, sf_dir):
    done = verify.verify_challenges(*challenges(spark, sf_dir))
    return verify.pending(done.withColumn("state", F.when(F.col("verified"), "verified").otherwise(F.col("state")))).select("domain", "token", "state")


@query
def verify_challenges(spark, sf_dir):
    return verify.verify_challenges(*challenges(spark, sf_dir))
