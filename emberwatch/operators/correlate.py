"""Kill-chain incidents: scan and brute-force detections of an actor closed by a login or by bait.

A completion (successful login, or a forwarded finding) is possible when the actor's latest brute force - for a
finding also the latest scan - lies at most one linking window before it. An incident uses up what it rests on
and silences its actor for the cooldown, so of the possible completions those remain that rest on something
newer than the incident before and come late enough (``thinning.consume``). Only narrow rows take part; texts
are fetched for the incidents. Which stages an incident names is then read off the detections after the one
before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberwatch.functions.fields import actor
from emberwatch.functions.text import or_default
from emberwatch.model import KIND_ORDER, SUCCESS_ORDER, ChainConfig
from emberwatch.operators.thinning import consume, floor_div
from emberwatch.operators.windows import micros
from emberwatch.plans.lineage import pin

SECOND = 1_000_000
INCIDENT_COLUMNS = (
    "severity", "actor", "target", "title", "detail", "stages", "members", "first_at", "last_at",
    "key", "source_id", "seq", "ord",
)


PLACE = ("us", "seq", "ord")
NEED = tuple(f"need_{c}" for c in PLACE)


def _pos() -> Column:
    return F.struct(*PLACE)


def login_completions(events: DataFrame, dets: DataFrame, window_us: int) -> DataFrame:
    """Successful logins within the window after the actor's latest brute force, which is their need.

    A brute force reaches until the next one of its actor or until the window ends, so each login
    meets at most one. The pairs are found with an equi-join on (actor, window-wide time bucket).
    """
    after = W.partitionBy("k").orderBy(_pos())
    bucket = floor_div(F.col("us"), window_us)
    brutes = (
        dets.where("kind = 'brute_force'")
        .withColumn("_next", F.lead(_pos()).over(after))
        .select("k", *[F.col(c).alias(f"need_{c}") for c in PLACE], _pos().alias("_bpos"), "_next",
                F.explode(F.array(bucket, bucket + 1)).alias("_b"))
    )
    here = _pos()
    met = _logins(events).select("k", "us", "seq", "ord").withColumn("_b", bucket).join(brutes, ["k", "_b"]).where(
        (F.col("_bpos") < here) & (F.col("_next").isNull() | (here < F.col("_next")))
        & (F.col("us") - F.col("need_us") <= window_us)
    )
    return met.select("k", *PLACE, F.lit("success").alias("kind"), *NEED)


def _logins(events: DataFrame) -> DataFrame:
    return micros(events.where("auth = 'success'")).select(
        actor().alias("k"), "us", "seq", F.lit(SUCCESS_ORDER).alias("ord"), "host", "user", "raw", "source_id")


def _latest(rows: DataFrame) -> DataFrame:
    """On scans, brutes and completions of an actor: the latest scan, brute and named target so far."""
    upto = W.partitionBy("k").orderBy("us", "seq", "ord").rowsBetween(W.unboundedPreceding, 0)
    stage = F.struct("us", "seq", "ord", "title")
    is_stage = F.col("kind").isin("scan", "brute_force")
    return rows.withColumns({
        "_scan": F.last(F.when(F.col("kind") == "scan", stage), ignorenulls=True).over(upto),
        "_brute": F.last(F.when(F.col("kind") == "brute_force", stage), ignorenulls=True).over(upto),
        "_target": F.last(
            F.when(is_stage & (F.col("host") != ""), F.struct("us", "seq", "ord", "host")), ignorenulls=True
        ).over(upto),
    })


def _after(stage: Column, previous: Column) -> Column:
    """The remembered stage, unless the previous incident already consumed it."""
    place = F.struct(stage["us"], stage["seq"], stage["ord"])
    return F.when(previous.isNull() | (place > previous), stage)


def incidents(events: DataFrame, detections: DataFrame, cfg: ChainConfig) -> DataFrame:
    """Escalated incidents of all actors."""
    window, cooldown = cfg.window_s * SECOND, cfg.cooldown_s * SECOND
    dets = detections.where(
        F.col("kind").isin("scan", "brute_force", "sentinel_finding") & (F.col("actor") != "")
    ).select(
        "kind", F.col("actor").alias("k"), F.unix_micros("last_at").alias("us"), "seq", "ord", "title",
        F.col("target").alias("host"), "source_id",
    )
    stages = dets.where("kind != 'sentinel_finding'")

    live = _live(window)
    place = lambda stage: F.when(live(stage), F.struct(*[stage[c].alias(c) for c in PLACE]))
    bait = (
        _latest(dets).where("kind = 'sentinel_finding'").withColumn("_need", F.greatest(place(F.col("_scan")), place(F.col("_brute"))))
        .where("_need is not null").select("k", *PLACE, "kind", *[F.col("_need")[c].alias(n) for c, n in zip(PLACE, NEED)])
    )
    # of completions with the same need in one microsecond only the first can fire
    done = login_completions(events, dets, window).unionByName(bait).groupBy("k", "us", "kind", *NEED).agg(F.min(F.struct("seq", "ord")).alias("_x"))
    fired = pin(consume(done.select("k", "us", "_x.*", "kind", *NEED), "k", cooldown, max(window, cooldown) + 1))
    by_login = fired.where("kind = 'success'").join(_logins(events), ["k", *PLACE]).withColumn("title", F.lit(""))
    by_bait = fired.where("kind != 'success'").join(dets.drop("kind"), ["k", *PLACE])
    fired = by_login.unionByName(by_bait, allowMissingColumns=True)

    # Detections are at least their cooldown apart and incidents rest on them, so an actor has few of either here.
    order = W.partitionBy("k").orderBy(*PLACE)
    fired = fired.withColumn("_prev", F.lag(_pos()).over(order))
    seen = _latest(stages.unionByName(fired, allowMissingColumns=True)).where("kind in ('success', 'sentinel_finding')")
    seen = seen.withColumns({c: _after(F.col(c), F.col("_prev")) for c in ("_scan", "_brute", "_target")})
    return describe(seen, cfg)


def _live(window_us: int):
    return lambda stage: stage.isNotNull() & (F.col("us") - stage["us"] <= window_us) & (stage["us"] <= F.col("us"))


def describe(seen: DataFrame, cfg: ChainConfig) -> DataFrame:
    """Incidents from their completions (k, us, seq, ord, kind, title, host, user, raw, source_id) with the latest stages
    before them (_scan, _brute: us, title; _target: host) that no earlier incident used, of a batch or a stream."""
    window = cfg.window_s * SECOND
    live = _live(window)
    scan, brute, us = F.col("_scan"), F.col("_brute"), F.col("us")
    bait = F.col("kind") == "sentinel_finding"
    near_brute = scan.isNotNull() & (brute["us"] - scan["us"] <= window) & (scan["us"] <= brute["us"])
    seen = seen.withColumns({
        "_has_scan": F.when(bait, live(scan)).otherwise(F.coalesce(near_brute, F.lit(False))),
        "_has_brute": F.when(bait, live(brute)).otherwise(F.lit(True)),
        "target": F.when(F.col("host") != "", F.col("host")).otherwise(F.coalesce(F.col("_target")["host"], F.lit(""))),
    })
    has_scan, has_brute = F.col("_has_scan"), F.col("_has_brute")
    k, place = F.col("k"), or_default(F.col("target"), "the host")

    def member(at: Column, stage: str, note: Column) -> Column:
        return F.struct(F.timestamp_micros(at).alias("at"), F.lit(stage).alias("stage"), note.alias("note"))

    note = (
        F.when(F.col("user") != "", F.concat(F.lit("successful login as "), F.col("user"), F.lit(" on "), place))
        .when(F.col("raw") != "", F.col("raw"))
        .otherwise(F.concat(F.lit("successful login on "), place))
    )
    last = F.when(bait, member(us, "deception", F.col("title"))).otherwise(member(us, "success", note))
    members = F.array_compact(F.array(
        F.when(has_scan, member(scan["us"], "scan", scan["title"])),
        F.when(has_brute, member(brute["us"], "brute_force", brute["title"])),
        last,
    ))
    seen = seen.withColumn("members", members).withColumn("stages", F.transform("members", lambda m: m["stage"]))
    lead_in = F.array_join(F.slice("stages", F.lit(1), F.size("stages") - 1), " → ")
    phrase = (
        F.when(has_scan & has_brute, "a port scan and a brute-force attempt")
        .when(has_brute, "a brute-force attempt").otherwise("a port scan")
    )
    title = (
        F.when(bait, F.concat(F.lit("Confirmed intrusion from "), k, F.lit(": "), lead_in, F.lit(" → bait touched")))
        .when(has_scan, F.concat(F.lit("Likely intrusion from "), k, F.lit(": scan → brute force → successful login")))
        .otherwise(F.concat(F.lit("Successful login after brute force from "), k))
    )
    bait_detail = F.concat(
        k, F.lit(" tripped a decoy after "), phrase,
        F.lit(" from the same source. Bait has no legitimate users, so this is not a heuristic: treat the host as "
              "compromised, isolate it, and review everything that source touched."))
    login_detail = F.concat(
        k, F.lit(" authenticated successfully to "), place, F.lit(" immediately after a brute-force attempt"),
        F.when(has_scan, ", itself preceded by a port scan from the same source").otherwise(""),
        F.lit(". Treat as a possible account compromise: rotate the credential and review the session."))
    bait_first = F.when(has_scan & has_brute, F.least(scan["us"], brute["us"])).when(has_scan, scan["us"]).otherwise(brute["us"])
    first = F.when(bait, bait_first).otherwise(F.least(brute["us"], scan["us"]))
    return seen.select(
        F.when(bait | has_scan, "critical").otherwise("high").alias("severity"),
        k.alias("actor"), "target", title.alias("title"), F.when(bait, bait_detail).otherwise(login_detail).alias("detail"),
        "stages", "members", F.timestamp_micros(first).alias("first_at"), F.timestamp_micros(us).alias("last_at"),
        F.concat(F.lit("killchain|"), k).alias("key"), "source_id", "seq", "ord",
    )
