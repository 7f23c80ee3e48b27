"""Spelling variants against all pairs of words, with awkward tables."""

import random
import re
import zlib
from collections import Counter

import pytest

from emberwatch.llm import spellings

DOC = "doc_id bigint, text string, word string, n int"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(texts, damage=True):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    out = {}
    for w in n:
        around = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = around[0] if around and n[around[0]] >= 2 * n[w] else None
        out[w] = (form, n[w], len(around), n[form] if form else None)
    rows = {}
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (out[w][0], root, *out[w][1:])
    return rows


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def words_near_each_other(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("abé×xyz") for _ in range(r.randint(5, 9))) for _ in range(25)]
    more = []
    for w in base:
        for _ in range(6):
            i, c = r.randrange(len(w)), r.choice("abéxyz")
            more.append(r.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], "".join(r.sample(w, len(w))))))
    return base, more


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_against_all_pairs(spark, seed):
    r = random.Random(seed)
    base, more = words_near_each_other(seed)
    texts = [(i, " ".join(r.choice(base if r.random() < 0.6 else more) + r.choice(("", ",", "7", "")) for _ in range(r.randint(0, 60)))) for i in range(60)]
    texts += [(1000, None), (1001, ""), (1002, "  ...  "), (None, " ".join(base * 3)), (7, texts[7][1]), (7, texts[7][1]),
              (1003, " ".join(r.choice(base).upper() for _ in range(20000))), (1004, "ab" * 50_000 + " " + " ".join(["ab" * 50_000] * 2))]
    rows = [(i, t, "clash", 5) for i, t in texts]
    got = found(spellings.variants(spellings.vocabulary(spark.createDataFrame(rows, DOC).repartition(3))))
    assert got == plain(texts) and any(v[0] for v in got.values()) and any(v[1] != v[0] and v[0] for v in got.values())


@pytest.mark.parametrize("parts", [3, 4, 6])
def test_pairs_are_told_once_for_any_number_of_partitions(spark, parts):
    base, more = words_near_each_other(5)
    words = sorted({w for w in base + more if len(w) >= 5})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    got = [(r.a, r.b) for r in spellings.near_pairs(table, parts).collect()]
    assert sorted(got) == [(a, b) for a in words for b in words if a < b and near(a, b)]


def test_anagrams_are_not_near(spark):
    table = spark.createDataFrame([(w, 3) for w in ("abcdef", "abcdfe", "fedcba", "abcdeg")], "word string, n bigint")
    assert [(r.a, r.b) for r in spellings.near_pairs(table).collect()] == [("abcdef", "abcdeg")]


def test_chains_and_ties(spark):
    words = [("aaaaa", 4), ("aaaab", 8), ("aaabb", 16), ("aabbb", 100), ("aaaac", 8), ("zzzzz", 3)]
    got = found(spellings.variants(spark.createDataFrame(words, "word string, n bigint")))
    assert got["aaaaa"] == ("aaaab", "aabbb", 4, 2, 8)  # two near words of n 8: the smaller one
    assert got["aaaab"] == ("aaabb", "aabbb", 8, 3, 16)
    assert got["aabbb"] == (None, "aabbb", 100, 1, None) and got["zzzzz"] == (None, "zzzzz", 3, 0, None)


def test_no_words(spark):
    assert found(spellings.variants(spellings.vocabulary(spark.createDataFrame([], DOC)))) == {}
    assert found(spellings.variants(spellings.vocabulary(spark.createDataFrame([(1, "a b c", None, None)], DOC)))) == {}


def test_nothing_that_grows_with_the_vocabulary_is_broadcast(spark, monkeypatch):
    plans, pin = [], spellings.pin

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return pin(df, *rest)

    monkeypatch.setattr(spellings, "pin", noted)
    base, more = words_near_each_other(5)
    out = spellings.variants(spark.createDataFrame([(w, 3 + i % 9) for i, w in enumerate(sorted({*base, *more}))], "word string, n bigint"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [p for p in plans if "Join" in p]
    assert len(joins) >= 3 and not [p for p in joins if "Broadcast" in p]
