"""Online form of the detectors and of the kill-chain correlation.

What a batch computes over whole tables is kept here per key and changed row by row; the wording is that of
the batch (``operators.detectors``, ``operators.correlate``), applied to what the processors emit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from emberwatch.functions.fields import actor, token
from emberwatch.functions.text import or_default
from emberwatch.model import SUCCESS_ORDER, ChainConfig, DetectConfig
from emberwatch.operators import correlate, detectors
from emberwatch.operators.windows import EWMA_KEEP, EWMA_NEW
from emberwatch.streaming.ordered import SECOND, OrderedProcessor, run_ordered, watched

_ROW = "us bigint, seq bigint, v string, n bigint, raw string, host string, user string, src_ip string, source_id string, note string"
FIRE_SCHEMA = (
    "count bigint, sources bigint, total bigint, base double, first_us bigint, evidence array<string>, raw string, "
    "host string, user string, src_ip string, source_id string, note string"
)
_OWN = ("raw", "host", "user", "src_ip", "source_id", "note")


class _Detector(OrderedProcessor):
    """First row and first lines since the last fire, and when that was."""

    row_schema = _ROW
    fields = tuple(p.split()[0] for p in FIRE_SCHEMA.split(", "))

    def __init__(self, cfg: DetectConfig, window_s: int, ttl_s: int | None = None):
        self.cfg, self.window, self.cooldown = cfg, window_s * SECOND, cfg.cooldown_s * SECOND
        # Shorter than this, a forgotten key could fire again too early.
        self.ttl_us = max(ttl_s, window_s, cfg.cooldown_s) * SECOND if ttl_s else None

    def keep(self, handle) -> None:
        self.story = handle.getValueState("story", "fired bigint, first bigint, lines array<string>")

    def load(self) -> None:
        told = self.story.get() if self.story.exists() else (None, None, [])
        self.fired, self.first, self.lines = told[0], told[1], list(told[2])

    def save(self) -> None:
        self.story.update((self.fired, self.first, self.lines))

    def forget(self) -> None:
        self.story.clear()

    def note(self, row: dict) -> None:
        if self.first is None:
            self.first = row["us"]
        if row["raw"] and len(self.lines) < self.cfg.evidence_max:
            self.lines.append(row["raw"])

    def ready(self, row: dict) -> bool:
        return self.fired is None or row["us"] - self.fired >= self.cooldown

    def fire(self, row: dict, count: int, sources: int = 0, total: int = 0, base: float = 0.0) -> tuple:
        made = (count, sources, total, base, self.first, self.lines, *(row[c] for c in _OWN))
        self.fired, self.first, self.lines = row["us"], None, []
        return made


class _Window(_Detector):
    """Also the rows of the open window, a list per slot: each is written when it comes and read when it leaves.

    Rows, total and different values are counters; ``seen`` knows when each value was last there. Only what a
    trigger touches is read and written.
    """

    by_value = False

    def keep(self, handle) -> None:
        super().keep(handle)
        self.open = handle.getMapState("open", "slot bigint", "rows array<struct<us:bigint,v:string,n:bigint>>")
        self.seen = handle.getMapState("seen", "v string", "us bigint")
        self.sums = handle.getValueState("sums", "rows bigint, total bigint, different bigint")

    def load(self) -> None:
        super().load()
        self.rows, self.total, self.different = self.sums.get() if self.sums.exists() else (0, 0, 0)
        self.slots = deque(sorted(s for (s,) in self.open.keys())) if self.rows else deque()
        self.front: deque = deque()  # rows of the slot that is leaving
        self.fresh: dict[int, list] = {}  # slots that are not written yet
        self.latest: dict[str, int | None] = {}
        self.stored = bool(self.rows)

    def add(self, row: dict) -> None:
        us, v, slot = row["us"], row["v"], row["us"] // self.slot_us
        self._leave(us - self.window)
        if slot not in self.fresh:
            self.fresh[slot] = self._slot(slot)
            if not self.slots or self.slots[-1] != slot:
                self.slots.append(slot)
        self.fresh[slot].append((us, v, row["n"]))
        self.rows += 1
        self.total += row["n"]
        if self.by_value:
            if self._last(v) is None:
                self.different += 1
            self.latest[v] = us

    def _slot(self, slot: int) -> list:
        known = self.open.getValue((slot,)) if self.stored else None
        return [tuple(r) for r in known[0]] if known else []

    def _last(self, v: str) -> int | None:
        if v not in self.latest:
            known = self.seen.getValue((v,)) if self.stored else None
            self.latest[v] = known[0] if known else None
        return self.latest[v]

    def _leave(self, before: int) -> None:
        while True:
            if not self.front:
                if not self.slots or self.slots[0] * self.slot_us >= before:
                    return
                slot = self.slots.popleft()
                self.front = deque(self.fresh.pop(slot) if slot in self.fresh else self._slot(slot))
                if self.stored and self.open.containsKey((slot,)):
                    self.open.removeKey((slot,))
                self.leaving = slot
            while self.front and self.front[0][0] < before:
                us, v, n = self.front.popleft()
                self.rows -= 1
                self.total -= n
                if self.by_value and self._last(v) == us:
                    self.latest[v] = None
                    self.different -= 1
            if self.front:
                return

    def restart(self) -> None:
        if self.stored:
            self.open.clear()
            self.seen.clear()
        self.rows = self.total = self.different = 0
        self.slots, self.front, self.fresh, self.latest, self.stored = deque(), deque(), {}, {}, False

    def save(self) -> None:
        super().save()
        self.sums.update((self.rows, self.total, self.different))
        if self.front:  # what is left of a slot that is leaving
            self.fresh[self.leaving] = [*self.front, *self.fresh.get(self.leaving, [])]
        for slot, rows in self.fresh.items():
            self.open.updateValue((slot,), (rows,))
        for v, us in self.latest.items():
            if us is not None:
                self.seen.updateValue((v,), (us,))
            elif self.stored and self.seen.containsKey((v,)):
                self.seen.removeKey((v,))

    def forget(self) -> None:
        super().forget()
        for state in (self.open, self.seen, self.sums):
            state.clear()


class ThresholdDetector(_Window):
    """Rows and different values inside the window both reach their minimum; a fire starts the window anew."""

    def __init__(self, cfg, window_s, rows, values=None, count_values=False, ttl_s=None):
        super().__init__(cfg, window_s, ttl_s)
        self.least, self.values, self.count_values, self.by_value = rows, values or 0, count_values, values is not None

    def step(self, row):
        self.note(row)
        self.add(row)
        if self.rows < self.least or self.different < self.values or not self.ready(row):
            return None
        made = self.fire(row, self.different if self.count_values else self.rows, self.different)
        self.restart()
        return made


class EgressDetector(_Window):
    """Sliding sum against its exponential baseline."""

    def keep(self, handle) -> None:
        super().keep(handle)
        self.baseline = handle.getValueState("baseline", "base double, any boolean")

    def load(self) -> None:
        super().load()
        self.base, self.any = self.baseline.get() if self.baseline.exists() else (0.0, False)

    def save(self) -> None:
        super().save()
        self.baseline.update((self.base, self.any))

    def forget(self) -> None:
        super().forget()
        self.baseline.clear()

    def step(self, row):
        self.note(row)
        self.add(row)
        total, old = self.total, self.base
        self.base, self.any = EWMA_KEEP * old + EWMA_NEW * total if self.any else float(total), True
        if total < self.cfg.exfil_bytes or old == 0 or total < self.cfg.exfil_factor * old or not self.ready(row):
            return None
        return self.fire(row, 1, total=total, base=old)


class CooldownDetector(_Detector):
    """Every row, once per cooldown."""

    def step(self, row):
        if not self.ready(row):
            return None
        self.first, self.lines = row["us"], [row["raw"]]
        return self.fire(row, 1)


class ForwardedDetector(_Detector):
    """Per address: one fire per product and cooldown, evidence over all products."""

    def keep(self, handle) -> None:
        super().keep(handle)
        self.products = handle.getMapState("products", "product string", "us bigint")

    def load(self) -> None:
        super().load()
        self.last_of: dict[str, int] = {}

    def step(self, row):
        product = row["v"]
        if product not in self.last_of:
            known = self.products.getValue((product,))
            self.last_of[product] = known[0] if known else None
        if self.last_of[product] is not None and row["us"] - self.last_of[product] < self.cooldown:
            return None
        self.last_of[product] = row["us"]
        self.note(row)
        return (1, 0, 0, 0.0, row["us"], list(self.lines), *(row[c] for c in _OWN))

    def save(self) -> None:
        super().save()
        for product, us in self.last_of.items():
            if us is not None:
                self.products.updateValue((product,), (us,))

    def forget(self) -> None:
        super().forget()
        self.products.clear()


def _shape(rows: DataFrame, key, value=None, number=None, note=None) -> DataFrame:
    value = F.lit("") if value is None else value
    number = F.lit(1) if number is None else number
    return rows.select(
        key.alias("k"), "ts", "seq", value.alias("v"), number.cast("bigint").alias("n"), "raw", "host", "user", "src_ip", "source_id",
        (F.lit("") if note is None else note).alias("note"))


def brute_force(events: DataFrame, cfg: DetectConfig, delay: str, ttl_s: int | None = None) -> DataFrame:
    rows = _shape(watched(events, delay, (F.col("auth") == "failure") & (actor() != "")), actor())
    return run_ordered(rows, ThresholdDetector(cfg, cfg.brute_window_s, cfg.brute_failures, ttl_s=ttl_s), FIRE_SCHEMA)


def port_scan(events: DataFrame, cfg: DetectConfig, delay: str, ttl_s: int | None = None) -> DataFrame:
    rows = _shape(watched(events, delay, (F.col("src_ip") != "") & (F.col("dst_port") != 0)), F.col("src_ip"), F.col("dst_port").cast("string"))
    return run_ordered(rows, ThresholdDetector(cfg, cfg.scan_window_s, 1, cfg.scan_ports, True, ttl_s), FIRE_SCHEMA)


def exfil(events: DataFrame, cfg: DetectConfig, delay: str, ttl_s: int | None = None) -> DataFrame:
    """The baseline is forgotten with its host, so its time to live should span the longest usual silence."""
    rows = _shape(watched(events, delay, (F.col("bytes_out") > 0) & (F.col("host") != "")), F.col("host"), number=F.col("bytes_out"))
    return run_ordered(rows, EgressDetector(cfg, cfg.exfil_window_s, ttl_s), FIRE_SCHEMA)


def new_admin(events: DataFrame, cfg: DetectConfig, delay: str, ttl_s: int | None = None) -> DataFrame:
    rows = _shape(watched(events, delay, F.col("action") == "new_admin"), detectors.admin_key())
    return run_ordered(rows, CooldownDetector(cfg, 0, ttl_s), FIRE_SCHEMA)


def auth_spike(events: DataFrame, cfg: DetectConfig, delay: str, ttl_s: int | None = None) -> DataFrame:
    rows = _shape(watched(events, delay, F.col("auth") == "failure"), detectors.spike_key(), detectors.spike_source())
    return run_ordered(rows, ThresholdDetector(cfg, cfg.spike_window_s, cfg.spike_min, cfg.spike_sources, ttl_s=ttl_s), FIRE_SCHEMA)


def forwarded_finding(events: DataFrame, cfg: DetectConfig, delay: str, ttl_s: int | None = None) -> DataFrame:
    rows = watched(events, delay, detectors.is_forwarded())
    message = detectors.forwarded_message()
    return run_ordered(_shape(rows, F.col("src_ip"), token(message, "product"), note=message), ForwardedDetector(cfg, 0, ttl_s), FIRE_SCHEMA)


StreamDetector = Callable[..., DataFrame]
STREAM_DETECTORS: dict[str, StreamDetector] = {
    "brute_force": brute_force,
    "scan": port_scan,
    "exfil": exfil,
    "new_admin": new_admin,
    "auth_spike": auth_spike,
    "sentinel_finding": forwarded_finding,
}


def described(fires: DataFrame, kind: str, cfg: DetectConfig) -> DataFrame:
    """The fires of a stream detector as detections, worded as in a batch."""
    if kind == "sentinel_finding":
        fires = detectors.forwarded_tokens(fires.withColumnRenamed("note", "_msg"))
    elif kind == "exfil":
        fires = fires.withColumnRenamed("base", "base_before")
    return detectors.DESCRIBE[kind](fires.withColumnRenamed("sources", "_sources"), cfg)


def detect_stream(events: DataFrame, cfg: DetectConfig, delay: str, ttl_s: int | None = None) -> dict[str, DataFrame]:
    """Per kind a stream of full detections, equal to the batch's; land them for ``incidents`` and ``jobs.record_sink``."""
    return {kind: described(run(events, cfg, delay, ttl_s), kind, cfg) for kind, run in STREAM_DETECTORS.items()}


_STAGE = "us bigint, seq bigint, ord int, title string"


class ChainProcessor(OrderedProcessor):
    """Per actor: the latest scan, brute force and named host since the last incident, and when that was.

    A completion fires if something it can rest on is recent enough; which stages an incident names is decided
    by ``correlate.describe`` from what is emitted.
    """

    row_schema = "us bigint, seq bigint, ord int, kind string, title string, host string, user string, raw string, source_id string"
    fields = ("ord", "kind", "title", "host", "user", "raw", "source_id", "scan", "brute", "place")

    def __init__(self, cfg: ChainConfig, ttl_s: int | None = None):
        self.window, self.cooldown = cfg.window_s * SECOND, cfg.cooldown_s * SECOND
        # An incident may name a scan older than the window, as long as the actor is not forgotten.
        self.ttl_us = max(ttl_s, cfg.window_s, cfg.cooldown_s) * SECOND if ttl_s else None

    def keep(self, handle) -> None:
        self.stages = handle.getMapState("stages", "stage string", _STAGE)
        self.incident = handle.getValueState("incident", "us bigint")

    def load(self) -> None:
        self.now = {k[0]: tuple(v) for k, v in self.stages.iterator()}
        self.fired = self.incident.get()[0] if self.incident.exists() else None

    def save(self) -> None:
        self.stages.clear()
        for stage, at in self.now.items():
            self.stages.updateValue((stage,), at)
        if self.fired is not None:
            self.incident.update((self.fired,))

    def forget(self) -> None:
        self.stages.clear()
        self.incident.clear()

    def step(self, row):
        here = (row["us"], row["seq"], row["ord"])
        if row["kind"] in ("scan", "brute_force"):
            self.now[row["kind"]] = (*here, row["title"])
            if row["host"]:
                self.now["place"] = (*here, row["host"])
            return None
        rests_on = ("brute_force",) if row["kind"] == "success" else ("scan", "brute_force")
        recent = any(row["us"] - self.now[s][0] <= self.window for s in rests_on if s in self.now)
        if not recent or (self.fired is not None and row["us"] - self.fired < self.cooldown):
            return None
        made = tuple(row[c] for c in self.fields[:7]) + tuple(self.now.get(s) for s in ("scan", "brute_force", "place"))
        self.fired, self.now = row["us"], {}
        return made


def incidents(steps: DataFrame, cfg: ChainConfig, delay: str, ttl_s: int | None = None) -> DataFrame:
    """steps: stream of (k, ts, seq, ord, kind, title, host, user, raw, source_id), see below. Full incidents, for ``incident_records``."""
    stage = f"struct<{_STAGE.replace(' ', ':').replace(',:', ',')}>"
    schema = f"ord int, kind string, title string, host string, user string, raw string, source_id string, scan {stage}, brute {stage}, place {stage}"
    made = run_ordered(watched(steps, delay, F.col("kind") != "clock"), ChainProcessor(cfg, ttl_s), schema)
    seen = made.withColumnsRenamed({"scan": "_scan", "brute": "_brute"}).withColumn(
        "_target", F.when(F.col("place").isNotNull(), F.struct(F.col("place")["title"].alias("host")))).drop("place")
    return correlate.describe(seen, cfg)


def login_steps(events: DataFrame) -> DataFrame:
    """Logins as steps. Other events are of kind ``clock``: they only tell the time."""
    return events.select(
        actor().alias("k"), "ts", "seq", F.lit(SUCCESS_ORDER).alias("ord"), F.when(F.col("auth") == "success", "success").otherwise("clock").alias("kind"),
        F.lit("").alias("title"), "host", "user", "raw", "source_id")


def detection_steps(detections: DataFrame) -> DataFrame:
    wanted = detections.where("kind in ('scan', 'brute_force', 'sentinel_finding') and actor != ''")
    return wanted.select(F.col("actor").alias("k"), F.col("last_at").alias("ts"), "seq", "ord", "kind", "title",
                         F.col("target").alias("host"), F.lit("").alias("user"), F.lit("").alias("raw"), "source_id")
