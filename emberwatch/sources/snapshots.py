"""Keyed tables as versioned parquet snapshots, cut into buckets by a hash of the key.

A version is a commit file ``commits/<n>`` that names, per bucket, the folder its rows are in. A change that says
which keys it touches reads and rewrites the buckets of those keys only; the others stay where they are. The
commit is created only if nobody has created it before; whoever comes second computes its change again from the
newer version. So versions only grow, no writer overwrites what another reads or wrote, and a lost executor or a
failed job leaves the old version in force. A commit also carries the last batch of every stream that has been
folded in, so a replayed batch is recognised whatever else was written in between.

Old versions are removed once they are not among the newest ``keep`` and were replaced more than ``hold_s`` ago,
which has to be longer than any reader or writer takes; with them go the folders that no version names any more.

The folder must be in a store where a commit can be refused if its name is taken: a local one (by a hard link) or
HDFS, directly or through viewfs (by its rename). Others are refused.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

STORES = ("file", "hdfs", "viewfs")


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = (), buckets: int = 64, keep: int = 10, hold_s: float = 6 * 3600):
        """``keys`` are the columns of the table's key; without them there is one bucket."""
        self.spark, self.root, self.keys, self.keep, self.hold_s = spark, root.rstrip("/"), keys, keep, hold_s
        self.buckets = buckets if keys else 1
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.store = self._fs.getUri().getScheme()
        if self.store not in STORES:
            raise ValueError(f"snapshots need a store of {', '.join(STORES)}, not {self.store}: a taken commit could not be refused")

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """Number of the newest version, 0 if there is none."""
        return max(self._versions(), default=0)

    def _commit_of(self, version: int) -> dict:
        if not version:
            return {"folders": {}, "applied": {}, "at": 0}
        stream = self._fs.open(self._path(f"{self.root}/commits/{version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def read(self, schema: str, version: int | None = None) -> DataFrame:
        """The given or the newest version; an empty frame if there is none."""
        return self._rows(schema, self._commit_of(self.version() if version is None else version)["folders"].values())

    def _rows(self, schema: str, folders) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def update(self, schema: str, change: Callable[[DataFrame], DataFrame], stream: str | None = None, batch: int = 0,
               touched: DataFrame | None = None) -> int:
        """Write ``change`` of the newest version as the next one and return its number.

        ``touched`` has the key columns of all rows that may change or come: ``change`` then gets, and returns,
        the rows of their buckets only. A ``batch`` of a ``stream`` that is in already changes nothing.
        """
        mine = None
        if touched is not None and self.keys:  # at most as many numbers as there are buckets
            mine = {r[0] for r in touched.select(self._bucket().alias("b")).distinct().collect()}
        while True:
            version = self.version()
            commit = self._commit_of(version)
            if stream is not None and commit["applied"].get(stream, -1) >= batch:
                return version
            old = commit["folders"] if mine is None else {b: f for b, f in commit["folders"].items() if int(b) in mine}
            folder = f"v={version + 1}-{uuid.uuid4().hex}"
            rows = change(self._rows(schema, old.values())).withColumn("_bucket", self._bucket())
            (rows if self.buckets == 1 else rows.repartition("_bucket")).write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
            made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))]
            written = {n.removeprefix("_bucket="): f"{folder}/{n}" for n in made if n.startswith("_bucket=")}
            if mine is not None and (strange := {int(b) for b in written} - mine):
                raise ValueError(f"the change has rows of keys that it does not touch (buckets {sorted(strange)})")
            folders = {b: f for b, f in commit["folders"].items() if b not in old} | written
            applied = commit["applied"] | ({stream: batch} if stream is not None else {})
            if self._create(version + 1, json.dumps({"folders": folders, "applied": applied, "at": time.time()})):
                self.clean()
                return version + 1

    def clean(self, at_once: int = 100) -> None:
        """Remove the oldest versions that no reader can hold any more, and the folders that only they name.

        A folder that the next version does not name was replaced by it and does not come back.
        """
        versions = self._versions()
        for v, after in list(zip(versions[: -self.keep], versions[1:]))[:at_once]:
            later = self._commit_of(after)
            if later["at"] > time.time() - self.hold_s:
                break
            for f in set(self._commit_of(v)["folders"].values()) - set(later["folders"].values()):
                self._fs.delete(self._path(f"{self.root}/{f}"), True)
                whole = self._path(f"{self.root}/{f}").getParent()
                if not any(s.isDirectory() for s in self._fs.listStatus(whole)):
                    self._fs.delete(whole, True)
            self._fs.delete(self._path(f"{self.root}/commits/{v}"), False)

    def _create(self, version: int, text: str) -> bool:
        """Whether this call made the commit: the text goes to a file of its own, which then gets the name if it is free."""
        made = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(made)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.root}/commits/{version}")
        if self.store == "file":
            try:
                os.link(made.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                self._fs.delete(made, False)
        if not self._fs.rename(made, target):
            self._fs.delete(made, False)
            return False
        return True
