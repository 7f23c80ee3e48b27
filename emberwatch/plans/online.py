"""The online path: a stream of events to detections, incidents, tables, alerts and periodic rounds.

Each step lands what it finds in a folder of its own and the next one reads that as a stream, so steps fail,
restart and scale apart:

```
lines -> events -> found/<kind> -> incidents -> tables (detections, findings) + alerts/opened
clock  -> rounds on the tables -> alerts/rounds
alerts -> out/{lines,webhook,chat}
```
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.model import MODULE, ChainConfig, DetectConfig
from emberwatch.operators import records as rec
from emberwatch.plans.pipeline import record_alerts
from emberwatch.sources.snapshots import Snapshots
from emberwatch.streaming import detect, jobs
from emberwatch.streaming.ordered import use_rocksdb


@dataclass
class Online:
    """Where everything lies. Times of silence and delays are seconds."""

    spark: SparkSession
    folder: str
    detect: DetectConfig = DetectConfig()
    chain: ChainConfig = ChainConfig()
    delay_s: int = 60
    ttl_s: int | None = None
    module: str = MODULE
    minimum: str = ""
    trigger: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        use_rocksdb(self.spark)
        self.detections = Snapshots(self.spark, f"{self.folder}/tables/detections", ("source_id", "key"))
        self.findings = Snapshots(self.spark, f"{self.folder}/tables/findings", ("module", "fingerprint"))

    def _land(self, df: DataFrame, name: str) -> StreamingQuery:
        return (
            df.writeStream.format("parquet").queryName(name.replace("/", "_")).option("checkpointLocation", f"{self.folder}/checkpoints/{name}")
            .trigger(**(self.trigger or {"processingTime": "10 seconds"})).start(f"{self.folder}/{name}"))

    def _landed(self, name: str, schema) -> DataFrame:
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}")

    def parsed(self, events: DataFrame) -> StreamingQuery:
        """Parsed events are written once; parsing inside every detector's plan would be planned and done each time."""
        self._event_schema = events.schema
        return self._land(events, "events")

    def events(self) -> DataFrame:
        return self._landed("events", self._event_schema)

    def detectors(self, events: DataFrame) -> list[StreamingQuery]:
        found = detect.detect_stream(events, self.detect, f"{self.delay_s} seconds", self.ttl_s)
        self._detection_schema = next(iter(found.values())).schema
        return [self._land(df, f"found/{kind}") for kind, df in found.items()]

    def correlation(self, events: DataFrame) -> StreamingQuery:
        """Logins wait for the detections in front of them, which come up to a delay and two triggers later."""
        found = self._landed("found/*", self._detection_schema)
        steps = detect.login_steps(events).unionByName(detect.detection_steps(found))
        made = detect.incidents(steps, self.chain, f"{3 * self.delay_s} seconds", self.ttl_s)
        return self._land(rec.incident_records(made), "incidents")

    def _records(self) -> DataFrame:
        found = rec.detection_records(self._landed("found/*", self._detection_schema))
        return found.unionByName(self._landed("incidents", found.schema))

    def tables(self) -> StreamingQuery:
        return jobs.record_sink(self._records(), self.detections, self.findings, f"{self.folder}/checkpoints/tables", self.module, **self.trigger)

    def opened(self) -> StreamingQuery:
        return self._land(record_alerts(self._records(), self.module), "alerts/opened")

    def rounds(self, clock: DataFrame, sources: Callable[[], DataFrame], rates: Callable[[], DataFrame] | None = None) -> StreamingQuery:
        return jobs.periodic_rounds(clock, self.detections, sources, self.findings, f"{self.folder}/alerts/rounds", f"{self.folder}/checkpoints/rounds",
                                    rates, self.module, **self.trigger)

    def alerts(self, host: str = "-") -> list[StreamingQuery]:
        schema = record_alerts(rec.detection_records(self.spark.createDataFrame([], self._detection_schema)), self.module).schema
        opened = self._landed("alerts/opened", schema).drop("ord")
        rounds = self._landed("alerts/rounds/*", opened.schema)
        return [jobs.alert_sink(df, f"{self.folder}/out/{name}", f"{self.folder}/checkpoints/alerts_{name}", self.minimum, host, **self.trigger)
                for name, df in (("opened", opened), ("rounds", rounds))]

    def start(self, events: DataFrame, clock: DataFrame, sources: Callable[[], DataFrame], rates: Callable[[], DataFrame] | None = None,
              host: str = "-") -> list[StreamingQuery]:
        """Start everything. With an ``availableNow`` trigger each step is waited for, so the next one sees all of it."""
        running: list[StreamingQuery] = []

        def wait(*queries: StreamingQuery) -> None:
            running.extend(queries)
            if self.trigger.get("availableNow"):
                for q in queries:
                    q.awaitTermination()

        wait(self.parsed(events))
        wait(*self.detectors(self.events()))
        wait(self.correlation(self.events()))
        wait(self.tables(), self.opened())
        wait(self.rounds(clock, sources, rates))
        wait(*self.alerts(host))
        return running


def wall_clock(spark: SparkSession) -> DataFrame:
    """A clock for ``Online.rounds``: the rate source."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.col("timestamp"))
