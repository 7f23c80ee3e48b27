import random
from collections import Counter

import pytest

from emberwatch.operators.thinning import consume, restarting, thin


def sequential(rows, d):
    last, out = {}, set()
    for k, us in sorted(rows):
        if k not in last or us - last[k] >= d:
            last[k] = us
            out.add((k, us))
    return out


@pytest.mark.parametrize("d", [1, 7, 100, 5_000])
def test_matches_sequential(spark, d):
    rng = random.Random(d)
    rows = set()
    for k, (n, span) in {"dense": (600, 3_000), "sparse": (50, 6_000), "burst": (80, 400), "one": (1, 10)}.items():
        rows |= {(k, rng.randrange(-500, span)) for _ in range(n)}
    df = spark.createDataFrame([(k, us, f"{k}{us}") for k, us in sorted(rows)], "k string, us bigint, raw string")
    got = thin(df, "k", d).collect()
    assert {(r.k, r.us) for r in got} == sequential(rows, d) and all(r.raw == f"{r.k}{r.us}" for r in got)


def test_equal_distance_fires_and_closer_does_not(spark):
    df = spark.createDataFrame([("a", 0), ("a", 99), ("a", 100), ("a", 199), ("a", 200)], "k string, us bigint")
    assert sorted(r.us for r in thin(df, "k", 100).collect()) == [0, 100, 200]


def test_one_busy_key(spark):
    df = spark.range(0, 200_000).selectExpr("'a' as k", "id * 10 as us", "repeat('x', 300) as raw")
    assert thin(df, "k", 95).count() == 20_000


def test_empty(spark):
    assert thin(spark.createDataFrame([], "k string, us bigint"), "k", 5).count() == 0


@pytest.mark.parametrize("window,cooldown,need,need_values", [(50, 10, 4, 0), (50, 50, 1, 3), (30, 5, 5, 2), (20, 40, 3, 2)])
def test_restarting_window_matches_sequential(spark, window, cooldown, need, need_values):
    rng = random.Random(window + need)
    rows = [(k, rng.randrange(0, 1500), i, rng.choice("abcd")) for k in "xyz" for i in range(200)]
    want, state = set(), {}
    for k, us, seq, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        w, last = state.get(k, ([], None))
        w = [(u, x) for u, x in [*w, (us, v)] if u >= us - window]
        if len(w) >= need and len({x for _, x in w}) >= need_values and (last is None or us - last >= cooldown):
            want.add((k, us, seq, len(w), len(Counter(x for _, x in w))))
            w, last = [], us
        state[k] = (w, last)
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, v string")
    assert {tuple(r) for r in restarting(df, "k", window, cooldown, need, "v", need_values).collect()} == want


@pytest.mark.parametrize("need,need_values,values", [(400, 0, "ab"), (1, 40, [f"v{i}" for i in range(60)]), (30, 3, ["a"] * 50 + ["b", "c", None])])
def test_restarting_window_over_many_batches(spark, need, need_values, values):
    """One session of one key, longer than a batch, with a window of thousands of rows and far from full."""
    rng = random.Random(need)
    rows = [("hot", i // 3, i, rng.choice(values)) for i in range(35_000)]
    window, cooldown, want, w, last = 4000, 900, set(), [], None
    lo, seen = 0, Counter()
    for k, us, seq, v in rows:
        w.append((us, v))
        seen[v] += 1
        while w[lo][0] < us - window:
            seen[w[lo][1]] -= 1
            lo += 1
        different = sum(c > 0 for c in seen.values())
        if len(w) - lo >= need and different >= need_values and (last is None or us - last >= cooldown):
            want.add((k, us, seq, len(w) - lo, different))
            w, lo, last = [], 0, us
            seen.clear()
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, v string")
    got = {tuple(r) for r in restarting(df, "k", window, cooldown, need, "v", need_values).collect()}
    assert len(want) > 5 and got == want


@pytest.mark.parametrize("cooldown", [1, 40, 300])
def test_consumed_needs_match_sequential(spark, cooldown):
    rng = random.Random(cooldown)
    rows, window = [], 100
    for k in "xyz":
        places = sorted({(rng.randrange(3000), i, rng.randrange(2)) for i in range(1500)})
        latest = {"a": None, "b": None}
        for us, seq, o in places:
            what = rng.choice(["stage a", "stage b", "a", "a", "b", "b"])
            if what.startswith("stage"):
                latest[what[-1]] = (us, seq, o)
                continue
            # kind a rests on stages a only, kind b on the latest of both
            need = latest["a"] if what == "a" else max((x for x in latest.values() if x), default=None)
            if need and us - need[0] <= window:
                rows.append((k, us, seq, o, what, *need))
    want, last = set(), {}
    for k, us, seq, o, what, *need in sorted(rows):
        before = last.get(k)
        if before is None or (us - before[0] >= cooldown and tuple(need) > before):
            last[k] = (us, seq, o)
            want.add((k, us, seq, o, what))
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint, ord int, kind string, need_us bigint, need_seq bigint, need_ord int").repartition(4)
    assert {tuple(r) for r in consume(df, "k", cooldown, max(window, cooldown) + 1).collect()} == want and len(want) > 20
