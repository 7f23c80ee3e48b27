"""Exact top-k inner-product search with vector-approximation files.

Every vector becomes whole numbers floor(scale * x) and, per component, a cell of ``2**bits`` numbers.
Queries and candidates meet in blocks. In a pair of blocks the cells alone give an upper and a lower
bound of every score; the k-th largest lower bound rules most candidates out; the exact vectors of the
others are read in the order of their bounds until the k-th score is certain. The best k of each block
are merged per query.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part;
vectors of different lengths are compared as if padded with zeros; equal scores go to the smaller id;
a query is never its own candidate, by id, so copies of a query under other ids are candidates, and an
id that occurs twice counts twice; with fewer than k candidates all are returned. Sums beyond 63 bits
are held at the ends of the long range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a block; a pair of blocks is one unit of work of bounded size.
QUERY_BLOCK, DATA_BLOCK = 512, 4096
FOUND = "query_id bigint, vec_id bigint, score bigint"
_TOP = (1 << 63) - 1


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def _matrix(rows: pa.ListScalar, width: int) -> np.ndarray:
    lists = rows.values
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        first = np.concatenate([[0], np.cumsum(lengths)])[at]
        out[at, :n] = flat[first[:, None] + np.arange(n)]
    return out


def _exact(q: np.ndarray, rows: np.ndarray, safe: bool) -> list[int]:
    if safe:
        return (rows @ q).tolist()
    return [max(-_TOP - 1, min(_TOP, sum(a * b for a, b in zip(q.tolist(), r)))) for r in rows.tolist()]


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """The best k of a block for each query: (query, id, score)."""
    safe = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1] < 2.0**52
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    cells = (x >> bits).astype(np.float64)  # the approximation file of this block
    width = float((1 << bits) - 1)
    qf = q.astype(np.float64)
    near = (qf @ cells.T) * float(1 << bits)
    up, down = np.maximum(qf, 0).sum(1) * width, np.minimum(qf, 0).sum(1) * width
    slack = 0.0 if safe else np.inf  # beyond exact doubles nothing is ruled out
    for i, qid in enumerate(q_ids.tolist()):
        other = np.flatnonzero(ids != qid)
        if not len(other):
            continue
        high, low = near[i, other] + up[i], near[i, other] + down[i]
        enough = np.partition(low, len(low) - k)[len(low) - k] - slack if len(low) > k else -np.inf
        left = np.flatnonzero(high >= enough)
        left = left[np.lexsort((ids[other[left]], -high[left]))]
        best: list[tuple[int, int]] = []
        step = 4 * k
        for start in range(0, len(left), step):
            part = left[start : start + step]
            if len(best) == k and high[part[0]] + slack < -best[-1][0]:
                break  # no bound that follows reaches the k-th score
            at = other[part]
            best = sorted(best + list(zip((-s for s in _exact(q[i], x[at], safe)), ids[at].tolist())))[:k]
        for score, vid in best:
            yield qid, vid, -score


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, bits: int = 4, vec_id: str = "vec_id", embedding: str = "embedding",
          query_block: int = QUERY_BLOCK, data_block: int = DATA_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` selects its ``k`` best other rows."""
    good = vectors.where(usable(F.col(embedding))).select(
        F.col(vec_id).alias("id"), whole(F.col(embedding), scale).alias("v"), queries.alias("is_query")).where("id is not null")
    n, asked, width = good.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1)), F.max(F.size("v"))).first()
    nd, nq, width = -(-n // data_block), -(-asked // query_block), width or 0

    def blocks(df: DataFrame, parts: int, name: str) -> DataFrame:
        spread = F.pmod(F.xxhash64("id"), F.lit(max(parts, 1)))
        return df.groupBy(spread.alias(name)).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_v"))

    data = blocks(good, nd, "d").withColumn("q", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(nq, 1) - 1).cast("bigint"))))
    pairs = data.join(blocks(good.where("is_query"), nq, "q"), "q").repartition(max(1, nd * nq), "q", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c: batch.column(c)[i]  # noqa: E731, B023
                found = list(search_block(get("q_ids").values.to_numpy(), _matrix(get("q_v"), width), get("d_ids").values.to_numpy(), _matrix(get("d_v"), width), k, bits))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"])

    found = pairs.select("q_ids", "q_v", "d_ids", "d_v").mapInArrow(run, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
