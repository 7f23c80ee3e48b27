"""Batch and streaming readers of log lines, one row per line with its origin."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from emberwatch.functions.syslog import parse_lines, parse_syslog


def with_origin(lines: DataFrame, source_id: str, kind: str, host: str = "", app: str = "",
                received: Column | None = None) -> DataFrame:
    """Give raw lines (value) the columns the parsers expect.

    ``received`` stands in for lines without a readable time; by default it is the file's
    modification time, which unlike the wall clock is the same on every run. ``seq`` is the arrival
    order: files by modification time and name, lines by their place in the file. A stream does not know
    what else there is, so there a line has a hash of its source and file in the upper 31 bits and its place
    in the file below: equal lines differ, the lines of a file are in order, and a replay numbers them alike.
    """
    at = (received if received is not None else F.col("_metadata.file_modification_time")).cast("timestamp")
    if lines.isStreaming:
        file = F.pmod(F.xxhash64(F.lit(source_id), "_metadata.file_path"), F.lit(1 << 31)) * F.lit(1 << 32)
        numbered = _placed(lines.select("value", at.alias("recv_ts"), file.alias("_file"), F.col("_metadata.file_block_start").alias("_start")))
    else:
        numbered = _numbered(lines.select(
            "value", at.alias("recv_ts"), F.monotonically_increasing_id().alias("_id"),
            F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("_part")))
    return numbered.select(
        "value", "recv_ts", "seq", F.lit(kind).alias("source"), F.lit(source_id).alias("source_id"), F.lit(host).alias("host"), F.lit(app).alias("app"),
    )


def _placed(lines: DataFrame) -> DataFrame:
    """Replace ``_file`` and ``_start`` (first byte of the stretch that one task reads) by ``seq``.

    A stretch has no more lines than bytes, so first byte + number in the stretch grows over the stretches of a file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            file, start = batch.column("_file").to_numpy(), batch.column("_start").to_numpy()
            new = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
            seq = np.empty(batch.num_rows, np.int64)
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if (file[lo], start[lo]) != held:
                    held, count = (file[lo], start[lo]), 0
                seq[lo:hi] = file[lo] + start[lo] + np.arange(count, count + hi - lo)
                count += hi - lo
            yield pa.RecordBatch.from_arrays([batch.column("value"), batch.column("recv_ts"), pa.array(seq)], ["value", "recv_ts", "seq"])

    return lines.mapInArrow(run, "value string, recv_ts timestamp, seq bigint")


def _numbered(lines: DataFrame) -> DataFrame:
    """Replace ``_id``, which grows inside a stretch of a file that one task reads, by the arrival order ``seq``.

    The stretches (one row per file split) are put in order and given their first number.
    """
    parts = lines.groupBy("_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select("_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return lines.join(parts, "_part").withColumn("seq", F.col("_id") - F.col("_first") + F.col("_before"))


def read_lines(spark: SparkSession, path: str | list[str], source_id: str, kind: str = "file", host: str = "",
               app: str = "", received: Column | None = None) -> DataFrame:
    """Closed (rotated) log files, exported journals (kind journald) or container logs (kind docker)."""
    return with_origin(spark.read.text(path, lineSep="\n"), source_id, kind, host, app, received)


def stream_lines(spark: SparkSession, path: str, source_id: str, kind: str = "file", host: str = "", app: str = "",
                 received: Column | None = None, max_files: int = 1000) -> DataFrame:
    """The same for a folder to which rotated files are added."""
    found = spark.readStream.option("maxFilesPerTrigger", max_files).text(path, lineSep="\n")
    return with_origin(found, source_id, kind, host, app, received)


def parse_source(lines: DataFrame, kind: str) -> DataFrame:
    """Events of one source: captured syslog and forwarded Windows lines are framed, others plain."""
    if kind in ("syslog", "windows"):
        return parse_syslog(lines, kind)
    return parse_lines(lines)


def fan_in(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of event frames; an event without a source id gets the name of its source.

    ``seq`` stays unique: every source numbers its events in steps of the number of sources.
    """
    named = [
        df.withColumn("source_id", F.when(F.col("source_id") == "", F.lit(name)).otherwise(F.coalesce("source_id", F.lit(name))))
        .withColumn("seq", F.xxhash64(F.lit(name), "seq") if df.isStreaming else F.col("seq") * len(sources) + i)
        for i, (name, df) in enumerate(sources.items())
    ]
    return reduce(DataFrame.unionByName, named)
