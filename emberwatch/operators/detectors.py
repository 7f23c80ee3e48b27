"""The six windowed detectors.

Each one filters, reduces the events to one row per (key, microsecond) with map-side combining,
computes the sliding statistic, thins the rows over the threshold by the cooldown, and only then
goes back to the events of the keys that fired for first-seen times and evidence.

A fire also restarts its key's window. While the cooldown is longer than the window that restart
cannot change a later fire: the key stays silent until the window lies wholly after the fire. For other
settings the rows are walked through in order (``restarting``).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from emberwatch.functions.fields import actor, token
from emberwatch.functions.text import human_bytes, one_decimal, or_default, span_text
from emberwatch.model import DETECTION_SCHEMA, KIND_ORDER, DetectConfig, columns
from emberwatch.operators import windows as win
from emberwatch.operators.thinning import floor_div, restarting, thin
from emberwatch.plans.lineage import pin

DETECTION_COLUMNS = columns(DETECTION_SCHEMA)
SECOND = 1_000_000


def nth_row(points: DataFrame, wanted: DataFrame, rank: str, limit: int) -> DataFrame:
    """(k, us, seq) of the ``rank``-th point by seq at each wanted (k, us); ranks are at most ``limit``.

    The constant bound lets Spark cut every group to ``limit`` rows before the shuffle.
    """
    order = W.partitionBy("k", "us").orderBy("seq")
    return (
        points.select("k", "us", "seq").join(wanted.select("k", "us", rank), ["k", "us"])
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= limit)
        .where(F.col("_rn") == F.col(rank))
        .select("k", "us", "seq")
    )


def close_segments(rows: DataFrame, fires: DataFrame, cooldown_us: int, evidence_max: int) -> DataFrame:
    """What each fire (k, us, seq, ...) ends: the rows of its key after the previous fire, up to itself.

    The fires are few but took scans to find and are needed three times, so they are pinned.
    Adds first_us, evidence (first non-empty raw lines) and the fire row's own host, user and
    source. Rows learn their fire through a map with one row per (key, cooldown-wide bucket): such
    a bucket holds at most one fire, and the fire of a later bucket is found on the map alone.
    """
    fires = pin(fires)
    at = F.struct(F.col("us").alias("us"), F.col("seq").alias("seq"))
    bucket = floor_div(F.col("us"), cooldown_us)
    rows = rows.select("k", "us", "seq", "raw", "host", "user", "source_id", bucket.alias("_b"))
    own = fires.select("k", bucket.alias("_b"), at.alias("_own"))
    later = W.partitionBy("k").orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)
    fire_map = (
        rows.select("k", "_b").distinct()
        .join(fires.select("k").distinct(), "k", "left_semi")
        .join(own, ["k", "_b"], "left")
        .withColumn("_next", F.last("_own", ignorenulls=True).over(later))
        .where("_own is not null or _next is not null")
    )
    fire = F.col("_fire")
    tagged = (
        rows.join(fire_map, ["k", "_b"])
        .withColumn("_fire", F.when(F.col("_own").isNotNull() & (at <= F.col("_own")), F.col("_own")).otherwise(F.col("_next")))
        .where(fire.isNotNull())
        .withColumn("_cls", F.when(at == fire, 2).when(F.col("raw") == "", 1).otherwise(0))
    )
    low = tagged.withColumn(
        "_rn", F.row_number().over(W.partitionBy("k", "_fire", "_cls").orderBy("us", "seq"))
    ).where(F.col("_rn") <= evidence_max)
    lines = F.sort_array(F.collect_list(F.when(F.col("raw") != "", F.struct("us", "seq", "raw"))))
    last = F.max(F.when(F.col("_cls") == 2, F.struct("host", "user", "source_id")))
    return (
        low.groupBy("k", "_fire")
        .agg(F.min("us").alias("first_us"), F.slice(lines, 1, evidence_max).alias("_ev"), last.alias("_at"))
        .select(
            "k", fire["us"].alias("us"), fire["seq"].alias("seq"), "first_us",
            F.transform("_ev", lambda e: e["raw"]).alias("evidence"), "_at.*",
        )
        .join(fires, ["k", "us", "seq"])
    )


def finish(df: DataFrame, kind: str, **values: Column) -> DataFrame:
    """Shape a detector's rows as detections; anything not given is taken from the frame."""
    made = {
        "kind": F.lit(kind),
        "ord": F.lit(KIND_ORDER[kind]),
        "target": F.col("host"),
        "first_at": F.timestamp_micros("first_us"),
        "last_at": F.timestamp_micros("us"),
        **values,
    }
    out = df.withColumns({f"_o_{name}": col for name, col in made.items()})
    return out.select(*[F.col(f"_o_{c}" if c in made else c).alias(c) for c in DETECTION_COLUMNS])


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def brute_force(events: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Many failed logins of one actor inside the window."""
    cooldown = cfg.cooldown_s * SECOND
    rows = win.micros(events.where("auth = 'failure'")).withColumn("k", actor()).where("k != ''")
    if cfg.cooldown_s <= cfg.brute_window_s:
        fires = restarting(rows, "k", cfg.brute_window_s * SECOND, cooldown, cfg.brute_failures).drop("values")
    else:
        fires = _brute_fires(rows, cfg)
    return brute_detections(close_segments(rows, fires, cooldown, cfg.evidence_max), cfg)


def brute_detections(fires: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Fires (k, us, seq, count, first_us, evidence, host, user, source_id) of a batch or a stream, described."""
    k, n = F.col("k"), F.col("count")
    return finish(
        fires, "brute_force", severity=F.lit("high"), actor=k, key=_text("brute|", k),
        title=_text("Brute force: ", n, " failed logins from ", k),
        detail=_text(n, f" authentication failures within {span_text(cfg.brute_window_s)} (target ",
                     or_default(F.col("host"), "any"), ")."),
    )


def _brute_fires(rows: DataFrame, cfg: DetectConfig) -> DataFrame:
    """(k, us, seq, count) of the firing rows, for a cooldown longer than the window."""
    cooldown, need = cfg.cooldown_s * SECOND, cfg.brute_failures
    per_us = rows.groupBy("k", "us").agg(F.count(F.lit(1)).alias("cnt"))
    prior = F.col("prior")
    over = (
        win.prior_count(per_us, "k", cfg.brute_window_s * SECOND)
        .where(prior + F.col("cnt") >= need)
        .select("k", "us", F.greatest(need - prior, F.lit(1)).alias("j"), F.greatest(prior + 1, F.lit(need)).alias("count"))
    )
    fires = thin(over, "k", cooldown)
    return fires.join(nth_row(rows, fires, "j", need), ["k", "us"]).select("k", "us", "seq", "count")


def port_scan(events: DataFrame, cfg: DetectConfig) -> DataFrame:
    """One address touching many different ports inside the window."""
    cooldown, need = cfg.cooldown_s * SECOND, cfg.scan_ports
    rows = win.micros(events.where("src_ip != '' and dst_port != 0")).withColumn("k", F.col("src_ip"))
    if cfg.cooldown_s <= cfg.scan_window_s:
        fires = restarting(rows, "k", cfg.scan_window_s * SECOND, cooldown, 1, "dst_port", need).drop("count").withColumnRenamed("values", "count")
    else:
        fires = _scan_fires(rows, cfg)
    return scan_detections(close_segments(rows, fires, cooldown, cfg.evidence_max), cfg)


def scan_detections(fires: DataFrame, cfg: DetectConfig) -> DataFrame:
    k, n = F.col("k"), F.col("count")
    return finish(
        fires, "scan", severity=F.lit("medium"), actor=k, user=F.lit(""), key=_text("scan|", k),
        title=_text("Port scan: ", k, " hit ", n, " distinct ports"),
        detail=_text(n, f" distinct destination ports within {span_text(cfg.scan_window_s)}."),
    )


def _scan_fires(rows: DataFrame, cfg: DetectConfig) -> DataFrame:
    """(k, us, seq, count) of the firing rows, for a cooldown longer than the window."""
    cooldown, need = cfg.cooldown_s * SECOND, cfg.scan_ports
    slim = rows.select("k", "us", "seq", "dst_port")
    table, starts = win.prior_distinct(slim, "k", "dst_port", cfg.scan_window_s * SECOND)
    prior = F.col("prior_d")
    full = prior >= need
    over = table.where(prior + F.col("new_d") >= need).select(
        "k", "us", F.when(full, F.col("first_seq")).alias("_seq0"),
        F.when(full, F.lit(0)).otherwise(need - prior).alias("m"),
        F.when(full, prior + F.col("first_start").eqNullSafe(F.col("first_seq")).cast("bigint"))
        .otherwise(F.lit(need)).alias("count"),
    )
    fires = thin(over, "k", cooldown)
    nth = nth_row(starts, fires.where("m > 0"), "m", need).withColumnRenamed("seq", "_seqm")
    fires = fires.join(nth, ["k", "us"], "left").withColumn("seq", F.coalesce("_seq0", "_seqm"))
    return fires.select("k", "us", "seq", "count")


def egress_totals(events: DataFrame, window_s: int) -> tuple[DataFrame, DataFrame]:
    """Outbound rows per host (``k``) and, slim, the sliding total with its baseline before and after."""
    rows = win.micros(events.where("bytes_out > 0 and host != ''")).withColumn("k", F.col("host"))
    total = win.rolling_sum(rows.select("k", "us", "seq", "bytes_out"), "k", "bytes_out", window_s * SECOND)
    return rows, win.ewma(total, "k", "total")


def exfil(events: DataFrame, cfg: DetectConfig) -> DataFrame:
    """A host sending far more than its own baseline. The sliding sum is not restarted by a fire."""
    cooldown = cfg.cooldown_s * SECOND
    rows, totals = egress_totals(events, cfg.exfil_window_s)
    total, base = F.col("total"), F.col("base_before")
    over = (
        totals.where((total >= cfg.exfil_bytes) & (base != 0) & (total.cast("double") >= F.lit(cfg.exfil_factor) * base))
        .groupBy("k", "us")
        .agg(F.min(F.struct("seq", "total", "base_before")).alias("_x")).select("k", "us", "_x.*")
    )
    fires = thin(over, "k", cooldown)
    return exfil_detections(close_segments(rows, fires, cooldown, cfg.evidence_max), cfg)


def exfil_detections(fires: DataFrame, cfg: DetectConfig) -> DataFrame:
    """``fires`` also has ``total``, the bytes of the window, and ``base_before``."""
    k, total, base = F.col("k"), F.col("total"), F.col("base_before")
    size = human_bytes(total)
    return finish(
        fires, "exfil", severity=F.lit("high"), actor=k, user=F.lit(""), key=_text("exfil|", k),
        count=F.lit(1).cast("bigint"), first_at=F.timestamp_micros("us"),
        title=_text("Abnormal egress from ", k, ": ", size),
        detail=_text(size, f" outbound within {span_text(cfg.exfil_window_s)} — ~",
                     one_decimal(total.cast("double") / base), "× this host's baseline."),
    )


def admin_key() -> Column:
    return F.concat_ws("|", F.lit("newadmin"), or_default(F.col("host"), "any"), or_default(F.col("user"), "any"))


def new_admin(events: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Every new privileged account, once per cooldown for a host and user."""
    rows = win.micros(events.where("action = 'new_admin'")).withColumn("k", admin_key())
    fires = thin(rows.groupBy("k", "us").agg(F.min("seq").alias("seq")), "k", cfg.cooldown_s * SECOND)
    return admin_detections(rows.join(fires, ["k", "us", "seq"]), cfg)


def admin_detections(fires: DataFrame, cfg: DetectConfig) -> DataFrame:
    return finish(
        fires, "new_admin", severity=F.lit("high"), actor=actor(), key=F.col("k"),
        count=F.lit(1).cast("bigint"), first_at=F.timestamp_micros("us"), evidence=F.array("raw"),
        title=_text("New privileged account created: ", or_default(F.col("user"), "a new account")),
        detail=F.lit("A new user/admin account or privilege grant was recorded — a classic persistence step. "
                     "Confirm it was authorised."),
    )


def spike_key() -> Column:
    return F.concat_ws("/", or_default(F.col("host"), "any"), or_default(F.col("app"), "any"))


def spike_source() -> Column:
    return F.when(F.col("src_ip") != "", F.col("src_ip")).otherwise(or_default(F.col("user"), "any"))


def auth_spike(events: DataFrame, cfg: DetectConfig) -> DataFrame:
    """Many failures on one service from several sources."""
    cooldown, width = cfg.cooldown_s * SECOND, cfg.spike_window_s * SECOND
    rows = win.micros(events.where("auth = 'failure'")).withColumns({"k": spike_key(), "_src": spike_source()})
    if cfg.cooldown_s <= cfg.spike_window_s:
        fires = restarting(rows, "k", width, cooldown, cfg.spike_min, "_src", cfg.spike_sources).withColumnRenamed("values", "_sources")
    else:
        fires = _spike_fires(rows, cfg)
    return spike_detections(close_segments(rows, fires, cooldown, cfg.evidence_max), cfg)


def spike_detections(fires: DataFrame, cfg: DetectConfig) -> DataFrame:
    """``fires`` also has ``_sources``, the number of different sources."""
    k, n, src = F.col("k"), F.col("count"), F.col("_sources")
    return finish(
        fires, "auth_spike", severity=F.lit("medium"), actor=k, user=F.lit(""), key=_text("spike|", k),
        title=_text("Distributed auth-failure spike on ", k, ": ", n, " from ", src, " sources"),
        detail=_text(n, " auth failures on ", k, " from ", src,
                     f" distinct sources within {span_text(cfg.spike_window_s)} — looks like credential stuffing."),
    )


def _spike_fires(rows: DataFrame, cfg: DetectConfig) -> DataFrame:
    """(k, us, seq, count, _sources) of the firing rows, for a cooldown longer than the window."""
    cooldown, width = cfg.cooldown_s * SECOND, cfg.spike_window_s * SECOND
    need, need_d = cfg.spike_min, cfg.spike_sources
    table, starts = win.prior_distinct(rows.select("k", "us", "seq", "_src"), "k", "_src", width)
    prior, prior_d = F.col("prior"), F.col("prior_d")
    over = (
        win.prior_count(table, "k", width)
        .where((prior + F.col("cnt") >= need) & (prior_d + F.col("new_d") >= need_d))
        .select(
            "k", "us", "prior", "prior_d",
            F.greatest(need - prior, F.lit(1)).alias("j"), F.greatest(need_d - prior_d, F.lit(0)).alias("m"),
        )
    )
    fires = pin(thin(over, "k", cooldown))  # few rows, used four times below
    # The firing row is the first one that satisfies both: j-th row and m-th new source.
    by_rows = nth_row(rows, fires, "j", need)
    by_sources = nth_row(starts, fires.where("m > 0"), "m", need_d).withColumnRenamed("seq", "_seqm")
    fires = (
        fires.join(by_rows, ["k", "us"]).join(by_sources, ["k", "us"], "left")
        .withColumn("seq", F.greatest("seq", F.coalesce("_seqm", "seq"))).drop("_seqm", "j", "m")
    )
    fires = fires.join(_upto(rows, fires, "_rows"), ["k", "us"]).join(_upto(starts, fires, "_srcs"), ["k", "us"], "left")
    return fires.select(
        "k", "us", "seq", (prior + F.col("_rows")).alias("count"),
        (prior_d + F.coalesce("_srcs", F.lit(0))).alias("_sources"),
    )


def _upto(points: DataFrame, fires: DataFrame, name: str) -> DataFrame:
    """How many points of a fire's microsecond come up to the firing row."""
    mine = fires.select("k", "us", F.col("seq").alias("_at"))
    hit = points.select("k", "us", "seq").join(mine, ["k", "us"]).where("seq <= _at")
    return hit.groupBy("k", "us").agg(F.count(F.lit(1)).alias(name))


def forwarded_tokens(rows: DataFrame) -> DataFrame:
    """Adds what a forwarded message (``_msg``) says."""
    msg = F.col("_msg")
    return rows.withColumns({"_product": token(msg, "product"), "_sev": token(msg, "severity"), "_check": token(msg, "check")})


def forwarded_message() -> Column:
    return F.when(F.col("message") == "", F.col("raw")).otherwise(F.col("message"))


def is_forwarded() -> Column:
    """Whether an event is a severe open finding that another tool sent as a log line."""
    msg = forwarded_message()
    return (
        (F.col("src_ip") != "") & msg.contains("product=") & (token(msg, "product") != "")
        & token(msg, "severity").isin("critical", "high") & (token(msg, "status") != "resolved"))


def forwarded_finding(events: DataFrame, cfg: DetectConfig) -> DataFrame:
    """A severe finding another tool sent as a log line, once per product and address."""
    rows = win.micros(forwarded_tokens(events.where(is_forwarded()).withColumn("_msg", forwarded_message()))).withColumn("k", F.concat_ws("|", F.lit("sentinel"), "_product", "src_ip"))
    # narrow rows are thinned; texts are fetched for the few that fire
    fires = pin(thin(rows.groupBy("k", "us").agg(F.min("seq").alias("seq")), "k", cfg.cooldown_s * SECOND))
    fires = pin(rows.join(fires, ["k", "us", "seq"]).select("us", "seq", "host", "src_ip", "raw", "source_id", "_msg", "_product", "_sev", "_check"))
    # Evidence grows per address over all products and stops at its first few fired lines.
    early = (
        fires.where("raw != ''")
        .withColumn("_rn", F.row_number().over(W.partitionBy("src_ip").orderBy("us", "seq")))
        .where(F.col("_rn") <= cfg.evidence_max)
        .groupBy("src_ip").agg(F.sort_array(F.collect_list(F.struct("us", "seq", "raw"))).alias("_early"))
    )
    here = F.struct("us", "seq")
    known = F.filter("_early", lambda e: F.struct(e["us"].alias("us"), e["seq"].alias("seq")) <= here)
    out = fires.join(early, "src_ip", "left").withColumn(
        "evidence", F.coalesce(F.transform(known, lambda e: e["raw"]), F.array().cast("array<string>")))
    return forwarded_detections(out, cfg)


def forwarded_detections(fires: DataFrame, cfg: DetectConfig) -> DataFrame:
    ip, product, msg = F.col("src_ip"), F.col("_product"), F.col("_msg")
    return finish(
        fires, "sentinel_finding", severity=F.col("_sev"), actor=ip, user=F.lit(""), key=F.concat_ws("|", F.lit("sentinel"), product, ip),
        count=F.lit(1).cast("bigint"), first_at=F.timestamp_micros("us"),
        title=_text(product, " reported ", or_default(F.col("_check"), "any"), " from ", ip),
        detail=_text("A ", F.col("_sev"), " finding from ", product, " arrived over syslog: ", msg),
    )


# From fires, of a batch or a stream, to detections.
DESCRIBE: dict[str, Callable[[DataFrame, DetectConfig], DataFrame]] = {
    "brute_force": brute_detections, "scan": scan_detections, "exfil": exfil_detections,
    "new_admin": admin_detections, "auth_spike": spike_detections, "sentinel_finding": forwarded_detections,
}

Detector = Callable[[DataFrame, DetectConfig], DataFrame]

# Order inside one event. Users may add their own entries.
DETECTORS: dict[str, Detector] = {
    "brute_force": brute_force,
    "scan": port_scan,
    "exfil": exfil,
    "new_admin": new_admin,
    "auth_spike": auth_spike,
    "sentinel_finding": forwarded_finding,
}


def side_by_side(runs: list[tuple[Detector, Callable[[], DataFrame]]], cfg: DetectConfig) -> DataFrame:
    """The detections of detectors, each on the events its function makes. They do not depend on each other, so their jobs run at the same time."""
    def started(detector: Detector, events: Callable[[], DataFrame]) -> DataFrame:
        return detector(events(), cfg)

    spark = SparkSession.active()
    with ThreadPoolExecutor(len(runs)) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(started), *run) for run in runs]
        return reduce(DataFrame.unionByName, [f.result() for f in waiting])


def detect_all(events: DataFrame, cfg: DetectConfig, detectors: dict[str, Detector] | None = None) -> DataFrame:
    """All detections; ``ord`` is the order of detectors on one event."""
    return side_by_side([(d, lambda: events) for d in (detectors or DETECTORS).values()], cfg)
