"""Sliding counts, distinct counts, sums and an exponential average per key.

Frames are closed ([t-w, t]) and follow (us, seq) order, so rows with equal times are handled
exactly. Every row is followed by a mark where it leaves the window, and a sliding value is the
running sum over rows and marks (``scan``), so a key or a microsecond with most of the rows is
spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from emberwatch.operators.scan import running_blend, running_sum
from emberwatch.operators.thinning import floor_div
from emberwatch.plans.lineage import pin


def micros(df: DataFrame) -> DataFrame:
    """Add ``us``, the event time in microseconds."""
    return df.withColumn("us", F.unix_micros("ts"))


def _expiring(df: DataFrame, key: str, value: Column, window_us: int) -> DataFrame:
    """The rows with ``_d`` = ``value`` and, when each one leaves the window, a row that takes it back."""
    rows = df.withColumns({"_o": F.lit(1), "_d": value.cast("bigint")})
    seq = ["seq"] if "seq" in df.columns else []
    gone = rows.select(key, (F.col("us") + F.lit(window_us + 1)).alias("us"), *seq, F.lit(0).alias("_o"), (-F.col("_d")).alias("_d"))
    return rows.unionByName(gone, allowMissingColumns=True)


def _sliding(df: DataFrame, key: str, value: Column, window_us: int, name: str) -> DataFrame:
    order = ["us", "_o", *(["seq"] if "seq" in df.columns else [])]
    out = running_sum(_expiring(df, key, value, window_us), key, order, "_d", name)
    return out.where("_o = 1").select(*df.columns, name)


def rolling_count(df: DataFrame, key: str, window_us: int, name: str = "n") -> DataFrame:
    """Rows of the key in [us-w, us] up to and including each row."""
    return _sliding(df, key, F.lit(1), window_us, name)


def rolling_sum(df: DataFrame, key: str, value: str, window_us: int, name: str = "total") -> DataFrame:
    """Sum of an integer column over [us-w, us] up to and including each row."""
    return _sliding(df, key, F.coalesce(F.col(value), F.lit(0)), window_us, name)


def prior_count(per_us: DataFrame, key: str, window_us: int) -> DataFrame:
    """``per_us`` has one row per (key, us) with ``cnt``; add ``prior``, the count in [us-w, us)."""
    return _sliding(per_us, key, F.col("cnt"), window_us, "prior").withColumn("prior", F.col("prior") - F.col("cnt"))


def coverage(df: DataFrame, key: str, value: str, window_us: int) -> tuple[DataFrame, DataFrame]:
    """When each value of a key starts and stops being inside the sliding window.

    A sighting keeps its value alive for ``w``. In a time slot as wide as the window only the first
    sighting can start a stretch and only the last can end it, so everything else is dropped in the
    map-side aggregation. Returns (starts: key, us, seq) and (ends: key, us), where an end is the
    first microsecond without the value.
    """
    slots = (
        df.withColumn("_s", floor_div(F.col("us"), window_us))
        .groupBy(key, value, "_s")
        .agg(F.min(F.struct("us", "seq")).alias("_first"), F.max("us").alias("_last"))
    )
    order = W.partitionBy(key, value).orderBy("_s")
    # read for starts and for ends, and by callers again
    seen = pin(slots.select(
        key, "_first", "_last",
        F.lag("_last").over(order).alias("_prev"),
        F.lead("_first.us").over(order).alias("_next"),
    ))
    starts = seen.where(
        F.col("_prev").isNull() | (F.col("_first.us") - F.col("_prev") > F.lit(window_us))
    ).select(key, F.col("_first.us").alias("us"), F.col("_first.seq").alias("seq"))
    ends = seen.where(
        F.col("_next").isNull() | (F.col("_next") - F.col("_last") > F.lit(window_us))
    ).select(key, (F.col("_last") + F.lit(window_us + 1)).alias("us"))
    return starts, ends


def rolling_distinct(df: DataFrame, key: str, value: str, window_us: int, name: str = "n") -> DataFrame:
    """Distinct values whose latest sighting is in [us-w, us], up to and including each row."""
    starts, ends = coverage(df, key, value, window_us)
    rest = [c for c in df.columns if c not in (key, "us", "seq")]
    rows = df.withColumn("_o", F.lit(2)).withColumn("_d", F.lit(0))
    marks = (
        starts.withColumn("_o", F.lit(1)).withColumn("_d", F.lit(1))
        .unionByName(
            ends.withColumn("seq", F.lit(-1).cast("bigint")).withColumn("_o", F.lit(0)).withColumn("_d", F.lit(-1))
        )
    )
    # An end takes effect before any row of its microsecond, a start together with its own row.
    mixed = rows.unionByName(marks, allowMissingColumns=True).withColumn("_e", F.when(F.col("_o") == 0, 0).otherwise(1))
    summed = running_sum(mixed, key, ["us", "_e", "seq", "_o"], "_d", name)
    return summed.where("_o = 2").select(key, "us", "seq", *rest, name)


def prior_distinct(df: DataFrame, key: str, value: str, window_us: int) -> tuple[DataFrame, DataFrame]:
    """Per (key, us): ``prior_d`` distinct values alive before the first row of that microsecond.

    Also ``new_d`` values starting there, ``cnt`` rows, and the first row and first start by seq.
    The second result is the list of starts.
    """
    starts, ends = coverage(df, key, value, window_us)
    seen = df.select(key, "us", F.lit(1).alias("cnt"), F.col("seq").alias("first_seq"))
    begun = starts.select(key, "us", F.lit(1).alias("new_d"), F.col("seq").alias("first_start"))
    over = ends.select(key, "us", F.lit(1).alias("gone_d"))
    merged = (
        seen.unionByName(begun, allowMissingColumns=True).unionByName(over, allowMissingColumns=True)
        .groupBy(key, "us")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("cnt", "new_d", "gone_d")],
            F.min("first_seq").alias("first_seq"), F.min("first_start").alias("first_start"),
        )
        .withColumn("_net", F.col("new_d") - F.col("gone_d"))
    )
    # a range shuffle reads its input twice
    summed = running_sum(pin(merged), key, ["us"], "_net", "_upto")
    out = summed.withColumn("prior_d", F.col("_upto") - F.col("new_d")).where("cnt > 0")
    return out.select(key, "us", "cnt", "first_seq", "new_d", "first_start", "prior_d"), starts


# Fixed values of the exponential baseline.
EWMA_NEW, EWMA_KEEP = 0.2, 0.8


def ewma(df: DataFrame, key: str, value: str) -> DataFrame:
    """Add ``base_before`` (0 on a key's first row) and ``base_after`` of the running baseline in (us, seq) order."""
    return running_blend(df, key, ["us", "seq"], value, EWMA_KEEP, EWMA_NEW)
