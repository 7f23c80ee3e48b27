import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import scan, windows as win


@pytest.fixture(autouse=True)
def uncoalesced(spark):
    """Small tables would end up in one partition, where nothing is carried over."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def make_rows(seed, n=500, span=400, keys=3, values=6):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", rng.randrange(-50, span), i, f"v{rng.randrange(values)}", rng.randrange(1, 1000))
            for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, us bigint, seq bigint, v string, x bigint")


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0], r[1], r[2]))


@pytest.mark.parametrize("w", [1, 7, 40])
def test_rolling_match_sequential(spark, w):
    rows = make_rows(w)
    df = frame(spark, rows)
    cnt, dis, tot = {}, {}, {}
    for i, (k, us, seq, v, x) in enumerate(ordered(rows)):
        upto = [r for r in ordered(rows)[: i + 1] if r[0] == k and r[1] >= us - w]
        cnt[seq], dis[seq], tot[seq] = len(upto), len({r[3] for r in upto}), sum(r[4] for r in upto)
    assert {r.seq: r.n for r in win.rolling_count(df, "k", w).collect()} == cnt
    assert {r.seq: r.n for r in win.rolling_distinct(df, "k", "v", w).collect()} == dis
    assert {r.seq: r.total for r in win.rolling_sum(df, "k", "x", w).collect()} == tot


@pytest.mark.parametrize("n, span", [(2500, 3000), (30_000, 1), (30_000, 10**6)])
def test_ewma_matches_sequential(spark, n, span):
    rng = random.Random(n)
    rows = [("a", rng.randrange(span), i, "", rng.randrange(1, 10**9)) for i in range(n)]
    rows += [("b", 5, 90_001, "", 77), ("c", 5, 90_002, "", 10**12), ("c", 6, 90_003, "", 1)] + [(f"k{i}", 0, 10**6 + i, "", 5) for i in range(300)]
    base, before, after = {}, {}, {}
    for k, _, seq, _, x in ordered(rows):
        before[seq] = base.get(k, 0.0)
        base[k] = float(x) if k not in base else 0.8 * base[k] + 0.2 * x
        after[seq] = base[k]
    got = win.ewma(frame(spark, rows).repartition(6), "k", "x").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_before == pytest.approx(before[r.seq], rel=1e-12)
        assert r.base_after == pytest.approx(after[r.seq], rel=1e-12)


def test_prior_tables(spark):
    rows = make_rows(5)
    df, w = frame(spark, rows), 9
    per_us = df.groupBy("k", "us").agg(F.count(F.lit(1)).alias("cnt"))
    for r in win.prior_count(per_us, "k", w).collect():
        assert r.prior == sum(1 for q in rows if q[0] == r.k and r.us - w <= q[1] < r.us)
    for r in win.prior_distinct(df, "k", "v", w)[0].collect():
        assert r.prior_d == len({q[3] for q in rows if q[0] == r.k and r.us - w <= q[1] < r.us})


@pytest.mark.parametrize("span", [1, 50, 10**6])
def test_one_key_with_most_rows_is_spread_over_tasks(spark, span):
    rng = random.Random(span)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(40)}", rng.randrange(span), i, f"v{rng.randrange(5)}", rng.randrange(-50, 1000)) for i in range(40_000)]
    df, w = frame(spark, rows).repartition(8), max(1, span // 7)
    local = scan._local_pass(df, "k", ["us", "seq"], "x", "_local bigint", scan._add())
    sizes = [r["count"] for r in local.groupBy("_p").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * len(rows)
    assert local.where("_last").count() == len(sizes)
    want, times = {}, {}
    for k, us, seq, _, x in ordered(rows):
        mine = times.setdefault(k, [])
        mine.append((us, x))
    for k, mine in times.items():
        lo = total = 0
        seqs = [r[2] for r in ordered(rows) if r[0] == k]
        for i, (us, x) in enumerate(mine):
            total += x
            while mine[lo][0] < us - w:
                total -= mine[lo][1]
                lo += 1
            want[seqs[i]] = (total, i + 1 - lo)
    got = {r.seq: r.total for r in win.rolling_sum(df, "k", "x", w).collect()}
    count = {r.seq: r.n for r in win.rolling_count(df, "k", w).collect()}
    assert {s: (got[s], count[s]) for s in got} == want


def test_running_sum_of_awkward_rows(spark):
    rows = [(None, 1, 1, 5), (None, 1, 2, None), ("", 0, 3, -7), ("a", -5, 4, 2**62), ("a", 5, 5, -(2**62)), ("a", 6, 6, 1)]
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, x bigint")
    got = {r.seq: r.s for r in scan.running_sum(df, "k", ["us", "seq"], "x", "s").collect()}
    assert got == {1: 5, 2: 5, 3: -7, 4: 2**62, 5: 0, 6: 1}
    assert scan.running_sum(df.limit(0), "k", ["us", "seq"], "x", "s").count() == 0
    assert scan.running_blend(df.limit(0), "k", ["us", "seq"], "x", 0.8, 0.2).count() == 0
