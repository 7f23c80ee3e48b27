"""Batches of alerts: one opens with its first alert and closes after a pause or when it is full.

Which alert opens a batch depends on the batch before, but where a batch opened by a given alert ends does not.
So alerts are numbered in order and for every one the opening after it is computed as if it had opened a batch:
the first alert after the pause, or the one after that which made the batch full. Chunks of ``CHUNK`` successive
alerts are worked on side by side; of the alerts after a chunk its batches can only see the first ones of ``limit``
different keys. Inside a chunk the openings are followed up to the first one beyond it, from any alert; which of
these chains is the true one is then found from chunk to chunk by doubling. No task holds more than a chunk of
numbers, however long alerts go on without a pause.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window as W, functions as F

from emberwatch.operators.scan import running_sum
from emberwatch.plans.lineage import pin

#: Successive alerts that one task works on; more if so many do not hold 100 full batches.
CHUNK = 100_000
_KEY = ("kind", "module", "fingerprint")


def replay(alerts: DataFrame, seconds: int, limit: int, chunk: int = CHUNK) -> DataFrame:
    """``alerts`` without repeats inside a batch, plus ``batch``: the seq of the alert that opened it.

    A batch takes alerts for ``seconds`` and is full with ``limit`` different (kind, module, fingerprint).
    Alerts without a time are left out.
    """
    limit = max(limit, 1)
    chunk = max(chunk, 100 * limit) if chunk == CHUNK else chunk
    # written once, as the numbers have to stay with their rows
    wide = pin(alerts.withColumns({"_us": F.unix_micros("at"), "_id": F.monotonically_increasing_id()}).where("_us is not null"))
    rows = _numbered(wide, seconds * 1_000_000, chunk)
    nexts = pin(_nexts(rows, limit))
    opened = pin(_opened(nexts, _entries(nexts)))
    # rows before a chunk's first opening belong to the latest one of the chunks before
    order = W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    last = opened.groupBy("chunk").agg(F.max(F.struct("opener", "batch")).alias("_l"))
    carry = last.select("chunk", F.last(F.when(F.col("_l.opener").isNotNull(), F.col("_l")), ignorenulls=True).over(order).alias("_c"))
    known = F.col("opener").isNotNull()
    told = opened.join(F.broadcast(carry), "chunk").select(
        "_id", "place", "h", F.when(known, F.col("opener")).otherwise(F.col("_c.opener")).alias("opener"),
        F.when(known, F.col("batch")).otherwise(F.col("_c.batch")).alias("batch"))
    kept = told.groupBy("opener", "h").agg(F.min(F.struct("place", "_id", "batch")).alias("_x")).select("_x._id", "_x.batch")
    return wide.join(kept, "_id").select(*alerts.columns, "batch")


def _numbered(wide: DataFrame, pause: int, chunk: int) -> DataFrame:
    """(chunk, place, timeout, h, seq, _id): the place of every alert in order, from 0, and the first place at least the pause later."""
    rows = wide.select("_id", "_us", "seq", F.xxhash64(*[F.col(c).isNull() for c in _KEY], *_KEY).alias("h"))
    ends = rows.select("_id", (F.col("_us") + pause).alias("_us"), "seq", "h", F.lit(0).alias("_one"))
    both = rows.withColumn("_one", F.lit(1)).unionByName(ends).withColumns({"_k": F.lit(0), "_o": F.col("_one")})
    counted = running_sum(both, "_k", ["_us", "_o", "seq", "_id"], "_one", "_n")
    counted = pin(counted.select("_id", "_o", "seq", "h", "_n"))
    ends = counted.where("_o = 0").select("_id", F.col("_n").alias("timeout"))
    place = (F.col("_n") - 1).alias("place")
    return pin(counted.where("_o = 1").join(ends, "_id").select(F.floor((F.col("_n") - 1) / chunk).alias("chunk"), place, "timeout", "h", "seq", "_id"))


def _heads(rows: DataFrame, limit: int) -> list[tuple[int, int, int]]:
    """(chunk, place, h): the first alerts of ``limit`` different keys after every chunk; a hundredth of the alerts at most."""

    def first(table: pa.Table) -> pa.Table:
        h, place = table.column("h").to_numpy(), table.column("place").to_numpy()
        order = np.argsort(place)
        at = np.sort(np.unique(h[order], return_index=True)[1])[:limit]
        picked = order[at]
        return pa.table({"chunk": table.column("chunk").take(pa.array(picked)), "place": place[picked], "h": h[picked]})

    found: dict[int, list[tuple[int, int]]] = {}
    for r in rows.groupBy("chunk").applyInArrow(first, "chunk bigint, place bigint, h bigint").collect():
        found.setdefault(r.chunk, []).append((r.place, r.h))
    out, after = [], []
    for c in sorted(found, reverse=True):
        out += [(c, place, h) for place, h in after]
        seen: dict[int, int] = {}
        for place, h in [*sorted(found[c]), *after]:
            if len(seen) < limit:
                seen.setdefault(h, place)
        after = [(place, h) for h, place in seen.items()]
    return out


def _nexts(rows: DataFrame, limit: int) -> DataFrame:
    """(chunk, place, next, leave, h, seq, _id): the opening after a batch that this alert opens, and the first one beyond the chunk."""
    later = rows.sparkSession.createDataFrame(_heads(rows, limit), "chunk bigint, place bigint, h bigint")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, own = table.column("place").to_numpy(), int(pa.compute.sum(table.column("own")).as_py())
        timeout = table.column("timeout").slice(0, own).to_numpy()
        names, code = np.unique(table.column("h").to_numpy(), return_inverse=True)
        code, count, different, end = code.tolist(), [0] * len(names), 0, 0
        full = np.full(own, np.iinfo(np.int64).max)
        for i in range(own):  # the window of rows from i on that holds ``limit`` keys
            while different < limit and end < len(code):
                different += not count[code[end]]
                count[code[end]] += 1
                end += 1
            if different < limit:
                break
            full[i] = place[end - 1] + 1
            count[code[i]] -= 1
            different -= not count[code[i]]
        after = np.maximum(np.minimum(timeout, full), place[:own] + 1)
        begin = int(place[0])
        leave = after.tolist()
        for i in range(own - 1, -1, -1):
            if leave[i] < begin + own:
                leave[i] = leave[leave[i] - begin]
        kept = table.slice(0, own).select(["chunk", "place", "h", "seq", "_id"])
        return kept.append_column("next", pa.array(after)).append_column("leave", pa.array(leave, pa.int64()))

    kind = rows.schema["seq"].dataType.simpleString()
    both = rows.withColumn("own", F.lit(1)).unionByName(later.withColumn("own", F.lit(0)), allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(run, f"chunk bigint, place bigint, h bigint, seq {kind}, _id bigint, next bigint, leave bigint")


def _entries(nexts: DataFrame) -> DataFrame:
    """The places at which the chain of openings that begins with the first alert enters chunks."""
    spark = nexts.sparkSession
    chunks = nexts.agg(F.max("chunk")).first()[0] or 0
    begin = spark.createDataFrame([(0,)], "place bigint")
    nodes = nexts.select(F.col("leave").alias("place")).union(begin).distinct()
    jumps = pin(nexts.select("place", F.col("leave").alias("to")).join(nodes, "place", "left_semi"))
    entries, hops = begin, 1
    while hops <= chunks:  # entries: those within ``hops`` hops; jumps: that many hops at once
        entries = pin(entries.union(entries.join(jumps, "place").select(F.col("to").alias("place"))).distinct())
        hops *= 2
        if hops <= chunks:
            further = jumps.select(F.col("place").alias("to"), F.col("to").alias("_to"))
            jumps = pin(jumps.join(further, "to").select("place", F.col("_to").alias("to")))
    return entries


def _opened(nexts: DataFrame, entries: DataFrame) -> DataFrame:
    """(chunk, _id, place, h, opener, batch): place and seq of the alert that opened a row's batch, null if it lies before the chunk."""
    seq = nexts.schema["seq"].dataType.simpleString()
    entered = nexts.join(F.broadcast(entries), "place", "left_semi").select("chunk", F.col("place").alias("entry"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, entry = table.column("place").to_numpy(), table.column("entry")[0].as_py()
        begin, at, after = int(place[0]), [], table.column("next").to_pylist()
        while entry is not None and entry < begin + len(place):
            at.append(entry - begin)
            entry = after[entry - begin]
        turn = np.searchsorted(np.array(at, np.int64), np.arange(len(place)), side="right") - 1
        opener = pa.array([at[i] if i >= 0 else None for i in turn.tolist()], pa.int64())
        return table.select(["chunk", "_id", "place", "h"]).append_column("opener", pa.compute.add(opener, begin)).append_column("batch", table.column("seq").take(opener))

    return nexts.join(F.broadcast(entered), "chunk", "left").groupBy("chunk").applyInArrow(
        run, f"chunk bigint, _id bigint, place bigint, h bigint, opener bigint, batch {seq}")
