"""Conversation repair against a plain walk over rows, with awkward tables."""

import hashlib
import random
import re
import zlib

import pytest

from emberwatch.llm import turns
from pyspark.sql import functions as F

CONV = "conv_id bigint, turn bigint, role string, text string, symbols string, copies int, tag int"
WS = " \t\n\x0b\x0c\r"


def cheapest(symbols):
    """Least (cost, audit) by states, row after row; symbols are (initial, fault)."""
    nxt = {0: 2, 1: 2, 2: 3, 3: 2}

    def put(states):
        out = dict(states)
        for _ in range(2):
            for p, (c, t) in list(out.items()):
                q, e = nxt[p], (c + 2, t + "I")
                if q not in out or e < out[q]:
                    out[q] = e
        return out

    states = {0: (0, "")}
    for initial, fault in symbols:
        after = {}
        for p, (c, t) in put(states).items():
            ways = [(p, c + 3, t + "D")]
            if fault in ("", "truncated"):
                f = int(fault == "truncated")
                ways.append((nxt[p], c + 2 + f, t + "R"))
                if initial == "s" and p == 0:
                    ways.append((1, c + f, t + "K"))
                if initial == "u" and nxt[p] == 2:
                    ways.append((2, c + f, t + "K"))
                if initial == "a" and p == 2:
                    ways.append((3, c + f, t + "K"))
            for q, cost, text in ways:
                if q not in after or (cost, text) < after[q]:
                    after[q] = cost, text
        states = after
    return min(v for p, v in put(states).items() if p in (0, 3))


def plain(rows, broken=True):
    conversations = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if broken else 9
        mine = conversations.setdefault(conv, [])
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        mine += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out, repaired = {}, {}
    for conv, mine in conversations.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest()))
        seen, symbols = set(), []
        for _, role, text in mine:
            ink = text.rstrip(WS)
            fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, audit = cheapest(symbols)
        state, lines, left = 0, [], iter(mine)
        for e in audit:
            row = None if e == "I" else next(left)
            if e == "D":
                continue
            if e == "K":
                state = {"s": 1, "u": 2, "a": 3}[row[1][0]]
                lines.append((e, row[1], row[2]))
            else:
                state = 3 if state == 2 else 2
                lines.append((e, "user" if state == 2 else "assistant", row[2] if row else ""))
        placed = [t for t, _, _ in mine if t is not None]
        count = lambda f: sum(x == f for _, x in symbols)
        out[conv] = (
            max(placed) - min(placed) + 1 - len(set(placed)) if placed else 0, count("blank"), count("duplicate"), count("truncated"),
            sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(symbols, symbols[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest())
        repaired[conv] = lines
    return out, repaired


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def made(seed, n=150, longest=25):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        texts = [f"Text {conv} {i}{r.choice(('.', '!', '', ' ?  ', '. '))}" for i in range(6)] + ["", " \t\n", "\xa0."]
        for turn in range(r.randint(0, longest)):
            role = r.choice(("user", "assistant") * 6 + ("system", "tool", "", "usher", None))
            rows.append((conv, None if r.random() < 0.05 else turn * r.randint(1, 2), role, r.choice([*texts, f"Own {turn}.", None])))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*x, "clash", 3, 7) for x in rows], CONV).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_digest_against_a_plain_walk(spark, seed):
    rows = made(seed)
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes."), (9001, 3, "user", "x." * 200_000), (9001, 4, "assistant", "")]
    rows += [(9002, 5, "user", "Same.")] * 40 + [(9003, t, "assistant", "Again.") for t in range(30)]
    rows += [(i, t, ("user", "assistant")[t % 2], "Good. %d" % t + ".") for i in range(10_000, 10_300) for t in range(6)]  # common shapes
    assert found(turns.digest(turns.damage(table(spark, rows)))) == plain(rows)[0]


def test_long_conversation_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(1, t, r.choice(("user", "assistant", "system")), r.choice(("A.", "B", "C!", ""))+ (f" {t}." if r.random() < 0.9 else "")) for t in range(6000)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(3000)] + [(3, t // 4, "user", f"{t}.") for t in range(500)]
    told = turns.sequences(turns.whole(table(spark, rows)))
    assert {x.conv_id: len(x.symbols) for x in told.collect()} == {1: 6000, 2: 3000, 3: 500}
    assert found(turns.digest(turns.whole(table(spark, rows)))) == plain(rows, broken=False)[0]


def test_repaired_rows(spark):
    rows = made(5, n=60)
    want = plain(rows, broken=False)[1]
    got = {}
    for r in turns.repair(turns.whole(table(spark, rows))).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
        assert r.place == len(got[r.conv_id]) - 1
    assert got == {k: v for k, v in want.items() if v}
    for lines in got.values():
        assert re.fullmatch("s?(ua)+", "".join(role[0] for _, role, _ in lines))


@pytest.mark.parametrize("bounds", [(0, 512, 512), (12, 4, 512), (12, 512, 3), (16, 512, 4096)])
def test_bounds_of_the_grammar_change_nothing(spark, bounds):
    rows = made(6, n=80, longest=60)
    told = turns.sequences(turns.whole(table(spark, rows))).persist()
    grammar = turns.learn(told, *bounds)
    assert len(grammar.rounds) <= bounds[0] and grammar.rules <= bounds[1] and max(grammar.span.values()) <= max(bounds[2], 1)
    want = plain(rows, broken=False)[0]
    assert {r.conv_id: (r.cost, r.audit) for r in turns.audits(told, grammar).collect()} == {k: v[5:7] for k, v in want.items()}
    told.unpersist()


def test_rules_are_shared_and_expand_to_what_they_stand_for(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(50) for t in range(2, 2 + 2 * (c % 9 + 1))]
    told = turns.sequences(turns.whole(table(spark, rows)))
    grammar = turns.learn(told)
    assert 0 < grammar.rules < 12

    def expand(x):
        return [x] if x not in grammar.halves else [y for half in grammar.halves[x] for y in expand(half)]

    assert all(len(expand(x)) == grammar.span[x] and set(expand(x)) == {4 * turns.U, 4 * turns.A} for x in grammar.halves)


def test_no_conversations(spark):
    assert found(turns.digest(turns.damage(spark.createDataFrame([], CONV)))) == {}
    assert turns.repair(turns.whole(spark.createDataFrame([], CONV))).count() == 0


def test_everything_dropped(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = found(turns.digest(turns.damage(table(spark, [(dropped, 0, "user", "Hi.")]))))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert turns.damage(table(spark, [(dropped, 0, "user", "Hi.")])).where(F.col("copies") > 0).count() == 0
