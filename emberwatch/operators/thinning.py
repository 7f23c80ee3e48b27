"""Cooldown thinning: of a key's candidates keep the first, then each one at least ``d`` later.

The choice is greedy, so every kept candidate depends on the one before, but only up to a silence: a
candidate that follows a silence of at least the cooldown is kept whatever came before. Keys are
therefore cut into sessions at such silences. A session shorter than the cooldown keeps its first
candidate only, which is known from a summary of one row per (key, time bucket); the times of longer
sessions are sorted and walked through, one session per task at a time, jumping from fire to fire. The
walk holds one batch of times and the last fire, so its memory does not depend on the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberwatch.plans.lineage import pin


def floor_div(us: Column, width: int) -> Column:
    """Integer division that also floors negative times."""
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def thin(cands: DataFrame, key: str, cooldown_us: int) -> DataFrame:
    """Return the fired rows of ``cands``; it must hold at most one row per (``key``, ``us``).

    All columns are kept; only keys and times are sorted, the others are fetched for fired rows.
    """
    cands = pin(cands)
    times = cands.select(key, "us")
    cut = sessions(times, key, cooldown_us)
    spans = cut.groupBy(key, "_root").agg(F.max("_hi").alias("_end"))
    roots = spans.select(key, F.col("_root").alias("us"))
    long = cut.join(spans.where(F.col("_end") - F.col("_root") >= F.lit(cooldown_us)), [key, "_root"]).select(key, "_b", "_root")
    inside = times.withColumn("_b", floor_div(F.col("us"), cooldown_us)).join(long, [key, "_b"]).select(key, "_root", "us")
    later = _walk(inside, key, cooldown_us).where("us != _root").select(key, "us")
    return cands.join(roots.unionByName(later), [key, "us"]).select(*cands.columns)


def sessions(times: DataFrame, key: str, silence_us: int) -> DataFrame:
    """(key, _b, _hi, _root): per bucket as wide as the silence its latest time and its session's first one.

    Two times of one bucket are closer than the silence, so a bucket belongs to one session.
    """
    buckets = (
        times.withColumn("_b", floor_div(F.col("us"), silence_us))
        .groupBy(key, "_b").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    )
    order = W.partitionBy(key).orderBy("_b")
    gap = F.col("_lo") - F.lag("_hi").over(order)
    fresh = F.when(gap.isNull() | (gap >= F.lit(silence_us)), F.col("_lo"))
    root = F.last(fresh, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return buckets.withColumn("_root", root).select(key, "_b", "_hi", "_root")


def _walk(times: DataFrame, key: str, cooldown_us: int) -> DataFrame:
    """The fired (key, _root, us) of whole sessions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # session and latest fire so far
        for batch in batches:
            if not batch.num_rows:
                continue
            us, names = batch.column("us").to_numpy(), batch.column(key).dictionary_encode()
            code, root = names.indices.to_numpy(), batch.column("_root").to_numpy()
            new = np.flatnonzero((code[1:] != code[:-1]) | (root[1:] != root[:-1])) + 1
            kept = []
            for start, end in zip([0, *new.tolist()], [*new.tolist(), len(us)]):
                name = (names.dictionary[code[start]].as_py(), root[start])
                if name != held:
                    held, last = name, us[start] - cooldown_us
                at = start
                while (at := start + int(np.searchsorted(us[start:end], last + cooldown_us))) < end:
                    kept.append(at)
                    last = us[at]
            if kept:
                yield batch.take(pa.array(kept))

    kind = times.schema[key].dataType.simpleString()
    return times.repartition(key, "_root").sortWithinPartitions(key, "_root", "us").mapInArrow(run, f"`{key}` {kind}, _root bigint, us bigint")


def restarting(rows: DataFrame, key: str, window_us: int, cooldown_us: int, need: int, value: str | None = None, need_values: int = 0) -> DataFrame:
    """Fires of a sliding window that starts anew after every fire, for any cooldown.

    ``rows``: (key, us, seq[, value]). A row fires if, with the rows of its key inside [us - window, us]
    and after the previous fire, it makes at least ``need`` rows and ``need_values`` different values,
    at least the cooldown after that fire. Returns key, us, seq, count and values (0 without ``value``) of the
    firing rows.

    While the cooldown is longer than the window the restart changes nothing and ``thin`` does; this is
    for the other settings. Sessions (no silence longer than window and cooldown) are sorted streams. For
    a batch and the rows still in the window, the latest beginning of a full window is known for every row
    at once, by rank for rows and by where the last few different values were last seen for values; then
    the walk jumps from fire to fire. It holds two numbers per row of the open window.
    """
    silence = max(window_us, cooldown_us) + 1
    name = value or "us"
    cut = sessions(rows.select(key, "us"), key, silence).select(key, "_b", "_root")
    sorted_rows = (
        rows.select(key, "us", "seq", F.col(name).cast("string").alias("_v"))
        .withColumn("_b", floor_div(F.col("us"), silence)).join(cut, [key, "_b"])
        .select(key, "_root", "us", "seq", "_v").repartition(key, "_root").sortWithinPartitions(key, "_root", "us", "seq")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # session and time of its last fire
        us, code, dictionary = np.zeros(0, np.int64), np.zeros(0, np.int64), {}  # the open window
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(key).dictionary_encode()
            keys, root = names.indices.to_numpy(), batch.column("_root").to_numpy()
            times, values = batch.column("us").to_numpy(), batch.column("_v").dictionary_encode(null_encoding="encode")
            new = np.flatnonzero((keys[1:] != keys[:-1]) | (root[1:] != root[:-1])) + 1
            kept, counts, different = [], [], []
            for start, end in zip([0, *new.tolist()], [*new.tolist(), len(times)]):
                name = (names.dictionary[keys[start]].as_py(), root[start])
                if name != held:
                    held, last, us, code, dictionary = name, None, np.zeros(0, np.int64), np.zeros(0, np.int64), {}
                carried = len(us)
                us = np.concatenate([us, times[start:end]])
                if value is not None:
                    local, at = np.unique(values.indices.to_numpy()[start:end], return_inverse=True)
                    ids = np.array([dictionary.setdefault(values.dictionary[x].as_py(), len(dictionary)) for x in local.tolist()], np.int64)
                    code = np.concatenate([code, ids[at]])
                begin = 0  # the window never reaches behind the last fire
                full = filled(us, code)
                while True:
                    at = np.searchsorted(full, begin, side="left")  # rows that would fire if the window began here
                    at = max(int(at), carried)
                    if last is not None:
                        at = max(at, int(np.searchsorted(us, last + cooldown_us)))
                    at = next_ready(us, full, at, begin)
                    if at is None:
                        break
                    low = max(begin, int(np.searchsorted(us, us[at] - window_us)))
                    kept.append(start + at - carried)
                    counts.append(at + 1 - low)
                    different.append(len(np.unique(code[low : at + 1])) if value is not None else 0)
                    last, begin = int(us[at]), at + 1
                low = max(begin, int(np.searchsorted(us, us[-1] - window_us)))
                us, code = us[low:], code[low:]
                if len(dictionary) > 2 * len(us) + 1000:  # forget values that left the window
                    back = {i: v for v, i in dictionary.items()}
                    alive, code = np.unique(code, return_inverse=True)
                    dictionary = {back[x]: i for i, x in enumerate(alive.tolist())}
            if kept:
                picked = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([picked.column(c) for c in (key, "us", "seq")] + [pa.array(counts, pa.int64()), pa.array(different, pa.int64())], [key, "us", "seq", "count", "values"])

    def filled(us: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Per row the latest place where a window may begin so that it holds enough rows and values up to the row."""
        n = len(us)
        out = np.arange(n) - max(need, 1) + 1
        if need_values > 1:
            order = np.lexsort((np.arange(n), code))
            before = np.full(n, -1)
            again = np.flatnonzero(code[order][1:] == code[order][:-1])
            before[order[again + 1]] = order[again]  # the row's value was last seen there
            seen = np.arange(n)  # where the k-th latest different value was last seen, here k = 1
            for _ in range(need_values - 1):
                earlier = np.concatenate([[-1], seen[:-1]])
                # a value that is not among the k latest ones pushes them all down, else the later ones stay
                moved = before < earlier
                source = np.maximum.accumulate(np.where(moved, np.arange(n), -1))
                seen = np.where(source >= 0, earlier[source], -1)
            out = np.minimum(out, seen)
        return out

    def next_ready(us: np.ndarray, full: np.ndarray, at: int, begin: int) -> int | None:
        """First row from ``at`` on whose window, begun after the last fire, is full and not too old."""
        step = 256
        while at < len(us):
            piece = slice(at, at + step)
            far = full[piece]
            ok = np.flatnonzero((far >= begin) & (us[np.maximum(far, 0)] >= us[piece] - window_us))
            if len(ok):
                return at + int(ok[0])
            at, step = at + step, step * 4
        return None

    kind = rows.schema[key].dataType.simpleString()
    return sorted_rows.mapInArrow(run, f"`{key}` {kind}, us bigint, seq bigint, count bigint, values bigint")


def consume(cands: DataFrame, key: str, cooldown_us: int, silence_us: int) -> DataFrame:
    """Fires of candidates that each rest on an earlier event, which a fire uses up.

    ``cands``: (key, us, seq, ord, kind, need_us, need_seq, need_ord), where need is the place of the latest event
    a candidate can rest on; for one kind it never goes back in time. A candidate fires if its need came after the
    previous fire and that fire is at least the cooldown ago. Candidates more than ``silence_us`` after the one
    before must not depend on it. Returns key, us, seq, ord and kind of the fires.

    From one fire the next of either kind is found by bisection on its times and on its needs.
    """
    cands = pin(cands)
    cut = sessions(cands.select(key, "us"), key, silence_us).select(key, "_b", "_root")
    places = ["us", "seq", "ord"]
    needs = [f"need_{p}" for p in places]
    inside = cands.withColumn("_b", floor_div(F.col("us"), silence_us)).join(cut, [key, "_b"])
    inside = inside.select(key, "_root", *places, "kind", *needs).repartition(key, "_root").sortWithinPartitions(key, "_root", *places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # session and place of its last fire
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(key).dictionary_encode()
            code, root = names.indices.to_numpy(), batch.column("_root").to_numpy()
            at = [batch.column(p).to_numpy() for p in places]
            need = [batch.column(p).to_numpy() for p in needs]
            kinds = batch.column("kind").dictionary_encode().indices.to_numpy()
            new = np.flatnonzero((code[1:] != code[:-1]) | (root[1:] != root[:-1])) + 1
            kept = []
            for start, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                name = (names.dictionary[code[start]].as_py(), root[start])
                if name != held:
                    held, last = name, None
                groups = [start + np.flatnonzero(kinds[start:end] == k) for k in np.unique(kinds[start:end])]
                while True:
                    ahead = [i for g in groups if (i := later(g, at[0], need, last)) is not None]
                    if not ahead:
                        break
                    kept.append(min(ahead))
                    last = tuple(int(x[kept[-1]]) for x in at)
            if kept:
                yield batch.select([key, *places, "kind"]).take(pa.array(kept))

    def later(group: np.ndarray, us: np.ndarray, need: list[np.ndarray], last: tuple | None) -> int | None:
        """The first row of a kind that may fire after ``last``."""
        if last is None:
            return int(group[0])
        begin = int(np.searchsorted(us[group], last[0] + cooldown_us))
        first, behind = (int(np.searchsorted(need[0][group], last[0], side=s)) for s in ("left", "right"))
        tied = group[first:behind]  # needs in the microsecond of the fire: those after it in its order
        after = np.flatnonzero((need[1][tied] > last[1]) | ((need[1][tied] == last[1]) & (need[2][tied] > last[2])))
        begin = max(begin, first + int(after[0]) if len(after) else behind)
        return int(group[begin]) if begin < len(group) else None

    kind = cands.schema[key].dataType.simpleString()
    return inside.mapInArrow(run, f"`{key}` {kind}, us bigint, seq bigint, ord int, kind string")
