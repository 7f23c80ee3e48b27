"""Prefix scans over the rows of a key, split evenly over tasks however many rows one key has.

Rows are put in order by range over (key, order), so a key with most of the rows, even within one microsecond,
is cut over many partitions. Each partition scans its own rows from nothing. A partition can only continue the
last key of the one before, so what must be carried over is one row per partition: its last one. These rows are
chained per key and the carry is joined back; the table has at most as many rows as there are partitions,
which is why it is broadcast.

Two scans are needed: running sums, of which sliding counts, distinct counts and sums are differences, and the
recurrence s = keep * s + new * x, whose steps are affine maps and so compose over partitions as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from emberwatch.plans.lineage import pin

#: A local scan: values of some rows in order, where keys begin among them, and the state to go on from if the
#: first rows continue the key of the batch before (else None). Returns the columns and the state after.
Local = Callable[[np.ndarray, np.ndarray, tuple | None], tuple[list[np.ndarray], tuple]]


def _local_pass(df: DataFrame, key: str, order: list[str], value: str, columns: str, scan: Local) -> DataFrame:
    """``df`` in order with ``columns`` of the local scan, ``_p`` (partition), ``_head`` (rows of the partition's first
    key, which may continue an earlier one) and ``_last`` (the partition's last row)."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state, held, last_key, head = TaskContext.get().partitionId(), None, None, None, True

        def told(batch: pa.RecordBatch, flag: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, flag))], [*batch.schema.names, "_last"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            code = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
            begins = np.concatenate([[True], code[1:] != code[:-1]])
            goes_on = state is not None and keys[0] == last_key
            values, state = scan(batch.column(value).to_numpy(zero_copy_only=False), np.flatnonzero(begins), state if goes_on else None)
            first_change = int(np.flatnonzero(begins[1:])[0]) + 1 if begins[1:].any() else batch.num_rows
            if held is not None and not goes_on:
                head = False
            heads = np.arange(batch.num_rows) < (first_change if head else 0)
            head = head and first_change == batch.num_rows
            last_key = keys[batch.num_rows - 1]
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v) for v in values), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(heads)],
                [*batch.schema.names, *names, "_p", "_head"])
            if held is not None:
                yield told(held, False)
            if out.num_rows > 1:
                yield told(out.slice(0, out.num_rows - 1), False)
            held = out.slice(out.num_rows - 1, 1)
        if held is not None:
            yield told(held, True)

    ordered = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), columns, "_p int", "_head boolean", "_last boolean"])
    return pin(ordered.mapInArrow(run, schema))


def _carried(local: DataFrame, key: str, carry: DataFrame) -> DataFrame:
    """``local`` with the columns of ``carry`` (key, _p, ...) on the rows of a partition's first key."""
    named = carry.select(F.col(key).alias("_ck"), F.col("_p").alias("_cp"), *[c for c in carry.columns if c not in (key, "_p")])
    return local.join(F.broadcast(named), (F.col("_p") == F.col("_cp")) & F.col(key).eqNullSafe(F.col("_ck")) & F.col("_head"), "left").drop("_cp", "_ck")


def _add() -> Local:
    def scan(x: np.ndarray, begins: np.ndarray, state: tuple | None) -> tuple[list[np.ndarray], tuple]:
        total = np.cumsum(x, dtype=np.int64)
        before = np.concatenate([[0], total])[begins]
        if state is not None:
            before[0] -= state[0]
        total = total - np.repeat(before, np.diff(np.concatenate([begins, [len(x)]])))
        return [total], (int(total[-1]),)

    return scan


def running_sum(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add the sum of an integer column (null: 0) over the key's rows up to and including each one."""
    local = _local_pass(df.withColumn(value, F.coalesce(F.col(value).cast("bigint"), F.lit(0))), key, order, value, "_local bigint", _add())
    upto = W.partitionBy(key).orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    carry = local.where("_last").select(key, F.col("_p").alias("_from"), F.sum("_local").over(upto).alias("_carry"))
    out = _carried(local, key, _next_partition(local, carry))
    return out.withColumn(name, F.col("_local") + F.coalesce("_carry", F.lit(0))).select(*[c for c in df.columns if c != name], name)


def _next_partition(local: DataFrame, carry: DataFrame) -> DataFrame:
    """What partition ``_from`` leaves, under the number of the next partition that has rows."""
    parts = local.where("_last").select(F.col("_p").alias("_from"), F.lead("_p").over(W.orderBy("_p")).alias("_p"))
    return carry.join(parts, "_from").where("_p is not null").drop("_from")


def _blend(keep: float, new: float) -> Local:
    def scan(x: np.ndarray, begins: np.ndarray, state: tuple | None) -> tuple[list[np.ndarray], tuple]:
        # every row is the map s -> decay * s + add; maps of growing stretches are composed by doubling
        add, decay = new * x.astype(float), np.full(len(x), keep)
        decay[begins] = 0.0
        if state is not None:
            add[0] += keep * state[0]
        step = 1
        while step < len(x) and decay.any():
            add[step:], decay[step:] = add[step:] + decay[step:] * add[:-step], decay[step:] * decay[:-step]
            decay[:step] = 0.0
            step *= 2
        size = np.diff(np.concatenate([begins, [len(x)]]))
        rank = np.arange(1, len(x) + 1) - np.repeat(begins, size)
        first = np.repeat(x[begins].astype(float), size)
        prior = np.concatenate([[0.0], add[:-1]])
        prior[begins] = 0.0
        if state is not None:
            prior[0] = state[0]
            rank[: size[0]] += state[1]
            first[: size[0]] = state[2]
        return [prior, add, rank, first], (float(add[-1]), int(rank[-1]), float(first[-1]))

    return scan


def running_blend(df: DataFrame, key: str, order: list[str], value: str, keep: float, new: float) -> DataFrame:
    """Add ``base_before`` (0 on a key's first row) and ``base_after``: the value on the first row, then keep * base + new * value."""
    local = _local_pass(df, key, order, value, "_prior double, _after double, _rank bigint, _x1 double", _blend(keep, new))
    # a partition maps the base it is given to keep ** rows * base + its own end; chained per key over at most all partitions
    ends = local.where("_last").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_p", "_after", "_rank", "_x1"))).alias("_e"))
    start = F.struct(F.col("_e")[0]["_x1"].alias("base"), F.array().cast("array<struct<_from:int,_carry:double>>").alias("told"))

    def chain(at, e):
        base = F.pow(F.lit(keep), e["_rank"]) * at["base"] + e["_after"]
        return F.struct(base.alias("base"), F.concat(at["told"], F.array(F.struct(e["_p"].alias("_from"), base.alias("_carry")))).alias("told"))

    carry = ends.select(key, F.explode(F.aggregate("_e", start, chain)["told"]).alias("_c")).select(key, "_c.*")
    # a virtual base equal to the first value makes the first base that value
    given, begins = F.coalesce("_carry", "_x1"), F.col("_carry").isNull() & (F.col("_rank") == 1)
    before = F.when(begins, 0.0).otherwise(F.col("_prior") + F.pow(F.lit(keep), F.col("_rank") - 1) * given)
    after = F.when(begins, F.col("_x1")).otherwise(F.col("_after") + F.pow(F.lit(keep), F.col("_rank")) * given)
    out = _carried(local, key, _next_partition(local, carry))
    return out.withColumns({"base_before": before, "base_after": after}).select(*df.columns, "base_before", "base_after")
