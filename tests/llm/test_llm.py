"""The corpus operators against brute force, with the awkward rows of every kind of table."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from emberwatch.llm import decontaminate, langid, ngram_join, packing, passages, pii, repeats, site_lines, url_rules, vafile
from emberwatch.llm.arrow import BATCH_BYTES, bounded, minima
from emberwatch.llm.components import components
from emberwatch.llm.queries import held_out, tokenizer_path

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(seed, n=60, vocabulary=400):
    """Texts with copies, near copies, shared passages, nulls, empties and a very long one."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    draw = lambda k: [r.choice(words) for _ in range(k)]
    common = draw(60)
    texts = []
    for i in range(n):
        kind = r.random()
        t = draw(r.randint(1, 120))
        if texts and kind < 0.15:
            t = r.choice(texts).split()
        elif texts and kind < 0.4:
            t = r.choice(texts).split()
            for _ in range(r.randint(1, 4)):
                t[r.randrange(len(t))] = r.choice(words)
        elif kind < 0.55:
            t = draw(20) + common[r.randint(0, 5) :] + draw(10)
        texts.append(" ".join(t))
    return [*texts, None, "", "  \n\t ", "one two", "one two", " ".join(draw(20000)), "x" * 500]


def table(spark, texts, extra=""):
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(5)


def shingles(t, k=4):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked_groups(texts):
    s = [shingles(t) for t in texts]
    up = list(range(len(s)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s[i]), root(i)) for i in range(len(s))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join(spark, seed):
    texts = made(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(table(spark, texts)).collect()}
    assert got == linked_groups(texts)


def test_ngram_join_of_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for _ in range(120):  # some of these are near only to each other
        t = list(base)
        for _ in range(r.randint(1, 7)):
            t[r.randrange(150)] = f"v{r.randrange(40)}"
        texts.append(" ".join(t))
    tail = [f"t{i}" for i in range(40)]
    texts += [" ".join([f"u{i}x{j}" for j in range(30)] + tail) for i in range(60)]  # share a passage only
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.join(table(spark, texts)).collect()}
    assert got == linked_groups(texts)


def test_ngram_join_of_null_and_repeated_ids(spark):
    one, two, alone = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(1, one), (None, one), (None, alone), (2, two), (2, two), (3, two), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1), (0, 3, 1), (0, 3, None), (2, 3, 2), (2, 3, 2), (3, 3, 2), (4, 0, 4), (0, 0, None)], key=str)


def test_size_levels_cover_all_linked_sizes():
    bounds = ngram_join.levels(5000)
    level = lambda n: int(np.searchsorted(bounds, n, side="right")) - 1
    for n in range(1, 4000):
        assert level(n * 100 // 85) - level(n) in (0, 1)


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 4])
def test_repeats(spark, seed):
    texts = [*made(seed), "ab" * 200, "x" * 99, "x" * 100, "é" * 120]
    df = repeats.digest(repeats.remove_repeats(table(spark, texts)))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()} == brute_repeats(texts)


class Tasks:
    """Stands for a table: what would run in its tasks."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("what", [lambda: repeats.anchored(Tasks(), 100, 32), lambda: ngram_join.prefixes(Tasks())])
def test_places_of_a_batch_are_worked_out_in_bounded_memory(what):
    r = random.Random(11)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(400)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert 6 << 20 < batch.nbytes < 8 << 20
    tracemalloc.start()
    rows = sum(b.num_rows for b in what()(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 3000 and peak < 64 << 20


def test_sets_of_pieces_are_those_of_the_whole_batch():
    r = random.Random(12)
    texts = [*made(2), *(" ".join(f"w{r.randrange(900)}" for _ in range(r.randrange(300))) for _ in range(800))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert batch.nbytes > ngram_join.PIECE_BYTES
    for one, all_ in zip(ngram_join.sets(batch), ngram_join._sets(batch, ngram_join.K)):
        assert (one == all_).all()
    assert [len(x) for x in ngram_join.sets(batch.slice(0, 0))] == [0, 0, 0]


def test_batches_for_workers_are_bounded_by_bytes(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("64m", BATCH_BYTES), ("1m", "1m")):
            spark.conf.set(key, given)
            assert bounded(spark.range(1)).count() == 1
            assert spark.conf.get(key) == str(kept)
    finally:
        spark.conf.set(key, before)


def test_minima_are_leftmost():
    r = np.random.default_rng(0)
    for w in (1, 2, 3, 7, 8, 20):
        v = r.integers(0, 5, 100).astype(np.uint64)
        assert minima(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(len(v) - w + 1)]


def test_passages(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    draw = lambda n: [word() for _ in range(n)]
    passage = draw(80)
    edited = [w for i, w in enumerate(passage) if i != 33]
    edited[60] = "changed"
    texts = [" ".join(draw(50) + passage + draw(50)), " ".join(draw(10) + passage + draw(5)), " ".join(draw(30) + edited + draw(30)), " ".join(draw(200)), None, "", "a b c"]
    rows = {r.doc_id: r for r in passages.passages(table(spark, texts)).collect()}
    assert set(rows) == {1, 2}
    assert (rows[1].start_word, rows[1].n_words, rows[1].src_doc_id, rows[1].src_start_word, rows[1].identity) == (10, 80, 0, 50, 1.0)
    assert rows[2].src_doc_id == 0 and rows[2].start_word == 30 and rows[2].n_words == 79 and rows[2].src_n_words == 80 and 0.97 < rows[2].identity < 1


def brute_identity(a, b):
    """Share of words on the best diagonal of two passages, from their first to their last equal word."""
    same = [i for i, (x, y) in enumerate(zip(a, b)) if x == y]
    return len(same) / (same[-1] - same[0] + 1), same[-1] - same[0] + 1


def test_passages_with_edits_down_to_the_least_identity(spark):
    r = random.Random(8)
    draw = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    texts, want = [], {}
    for every in (5, 6, 8, 10, 12, 20):  # identities 0.8 to 0.95
        for size in (60, 100):
            for first in range(0, every, 2):
                passage = draw(size)
                edited = [f"edit{i}" if i % every == first else w for i, w in enumerate(passage)]
                texts.append(" ".join(draw(20) + passage + draw(20)))
                texts.append(" ".join(draw(30) + edited + draw(10)))
                want[len(texts) - 1] = brute_identity(passage, edited)
    want = {i: x for i, x in want.items() if x[0] >= 0.8}
    assert len(want) > 40
    rows = {x.doc_id: x for x in passages.passages(table(spark, texts)).collect()}
    assert set(rows) == set(want)
    for i, (_, n) in want.items():
        x = rows[i]
        assert x.src_doc_id == i - 1 and n - 2 * passages.K <= x.n_words <= n  # an end of under K words past an edit is no seed
        own, other = texts[i].split()[x.start_word :][: x.n_words], texts[i - 1].split()[x.src_start_word :][: x.src_n_words]
        assert math.isclose(x.identity, brute_identity(own, other)[0], abs_tol=1e-5) and x.identity >= 0.8


def test_packing_forgets_words_at_the_end_of_a_task_if_it_has_a_room():
    class Docs:
        def selectExpr(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["one two, three", "Four five. six", None]})
    want = [b.to_pylist() for b in packing.pieces(Docs(), tokenizer_path())(iter([batch, batch]))]
    assert len(packing.tokens(tokenizer_path()).known) > 1
    got = [b.to_pylist() for b in packing.pieces(Docs(), tokenizer_path(), room=10)(iter([batch, batch]))]
    assert got == want and packing.tokens(tokenizer_path()).known == {"": b""}


def test_passages_of_seeds_that_earlier_documents_hold_one_by_one(spark):
    r = random.Random(11)
    draw = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage = draw(60)
    pieces = [" ".join(draw(30) + passage[i : i + 9] + draw(30)) for i in range(0, 60, 6)]
    texts = [*pieces, " ".join(draw(20) + passage + draw(5)), " ".join(draw(7) + passage + draw(20))]
    rows = [tuple(x) for x in passages.passages(table(spark, texts)).collect()]
    assert rows == [(11, 7, 60, 10, 20, 60, 1.0)]


def test_passages_of_copies_and_repeated_rounds(spark):
    r = random.Random(12)
    draw = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, own = draw(50), " ".join(draw(45))
    copied = " ".join(draw(3) + passage)
    texts = [" ".join(passage + draw(9)), copied, copied, own, own, "one two", "one two",
             " ".join(draw(5) + ["on", "and"] * 40 + draw(6)), " ".join(draw(2) + ["and"] + ["on", "and"] * 30 + draw(4))]
    rows = {tuple(x) for x in passages.passages(table(spark, texts)).collect()}
    assert {x for x in rows if x[0] < 7} == {(1, 3, 50, 0, 0, 50, 1.0), (2, 0, 53, 1, 0, 53, 1.0), (4, 0, 45, 3, 0, 45, 1.0)}
    assert {(x[0], x[3]) for x in rows if x[0] >= 7} == {(8, 7)} and max(x[2] for x in rows if x[0] == 8) >= 60


def test_chains_match_a_quadratic_chaining():
    r = random.Random(1)
    for _ in range(40):
        frags = sorted({(r.randrange(200), r.randrange(200), r.randint(5, 20)) for _ in range(r.randint(1, 25))})
        best = []
        for i, (x, y, n) in enumerate(frags):
            before = [best[j] - passages.GAP_COST * (x - a - m + y - b - m) for j, (a, b, m) in enumerate(frags[:i]) if a + m <= x and b + m <= y]
            best.append(n + max([0, *before]))
        top = passages.chains(frags)[0]
        score = sum(n for _, _, n in top) - sum(passages.GAP_COST * (q[0] - p[0] - p[2] + q[1] - p[1] - p[2]) for p, q in zip(top, top[1:]))
        assert math.isclose(score, max(best))
        assert sorted(f for c in passages.chains(frags) for f in c) == frags


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*made(2), "word " * 9000, "a <|endoftext|> b", "Ünïcödé x́ it's 123\r\n\tΣΑΣ"]
    rows = packing.pack(table(spark, texts), tokenizer_path()).collect()
    coder, want = Tokenizer.from_file(tokenizer_path()), {}
    for i, t in enumerate(texts):
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, k] = (at, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096


def test_words_of_latin_letters_need_no_pass_of_the_whole_tokenizer():
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZàéîõüßñÿÀÉÑŸŁőſǅªºŉ"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) + r.choice(["", "", ",", "...", "###", "?!", "'", "$%"]) for _ in range(80)) for _ in range(20)]
    odd = ["İstanbul I\u0307 e\u0301a é\u0301. ΣΑΣ, \u212a x\u0301### don't 'S we'll' a1, b2### ·l· <|endoftext|> \u01c5\u01c5\ta\rb", "", "漢字, 12### ##a"]
    coder = packing.Tokens(tokenizer_path())
    for text, ids in zip(texts + odd, coder.encode(texts + odd)):
        assert np.asarray(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() == ids, text
    coder = packing.Tokens(tokenizer_path())
    coder.encode([", ... ### ?! ' $%"])
    want, coder.tokenizer = packing.Tokens(tokenizer_path()).encode(texts), None
    assert coder.encode(texts) == want


def test_packing_plan_uses_every_piece_and_finds_exact_fills():
    r = np.random.default_rng(3)
    for _ in range(20):
        limit = int(r.integers(5, 60))
        hist = {int(k): int(r.integers(1, 30)) for k in r.integers(1, limit + 1, 12)}
        plan = packing.plan(hist, limit)
        used = collections.Counter()
        for parts, times in plan:
            assert sum(parts) <= limit
            for x in parts:
                used[x] += times
        assert dict(used) == hist
    assert packing.plan({7: 2, 3: 1, 2: 1, 1: 1}, 10) == [((7, 3), 1), ((7, 2, 1), 1)]


def test_loose_letters_are_no_language(spark):
    r = random.Random(3)
    words = {"a": ["river", "stone", "under", "green", "walker", "singing", "morning"], "b": ["fluss", "stein", "unter", "gruen", "laeufer", "singen", "morgen"]}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(40)), x, "s", 0) for i in range(80) for x in "ab"]
    plain = [(1000 + i, " ".join(r.choice(words["ab"[i % 2]]) for _ in range(n)), None, "s", 0) for i, n in enumerate([1, 2, 3, 5, 10, 40, 400])]
    letters = [c for x in rows for c in x[1] if c != " "]
    loose = [(2000 + i, " ".join("".join(r.choice(letters) for _ in range(6)) for _ in range(n)), None, "s", 0) for i, n in enumerate([8, 20, 60, 400])]
    docs = spark.createDataFrame([(i, *x[1:]) for i, x in enumerate(rows)] + plain + loose, DOC)
    got = {x.doc_id: x for x in langid.identify(docs, docs["doc_id"] < 1000).collect()}
    assert all(got[x[0]].score > 0.9 and got[x[0]].lang_pred == "ab"[i % 2] for i, x in enumerate(plain)), [got[x[0]] for x in plain]
    assert all(got[x[0]].score < 0.1 for x in loose), [got[x[0]] for x in loose]
    assert all(got[i].score > 0.9 and got[i].lang_pred == x[2] for i, x in enumerate(rows))


def test_language(spark):
    r = random.Random(1)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(i, make("abcde" if i % 2 else "abxyzé", r.randint(3, 60)), "aa" if i % 2 else "xx", "s", 0) for i in range(200)]
    rows += [(1000, None, "aa", "s", 0), (1001, "12 34 ½ _", "xx", None, 0), (1002, "", None, None, 0), (1003, "ABCDE DEBA CAB" * 2000, None, None, 0)]
    docs = spark.createDataFrame(rows, DOC)
    got = {x.doc_id: x for x in langid.identify(docs.withColumn("held", held_out()), ~held_out(), keep=("doc_id", "held")).collect()}
    assert len(got) == len(rows)
    for i, t, lang, _, _ in rows:
        assert got[i].held == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1
        if i < 200:
            assert got[i].lang_pred == lang
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    none = langid.identify(docs.where("lang is null"), ~held_out())
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_code_lengths_are_those_of_a_context_tree():
    """Against a tree walked byte by byte."""
    import pyarrow as pa

    texts = ["abracadabra abra", "cad abra", "aé b"]
    grams = collections.Counter()
    for t in texts:
        b = bytes(3) + t.encode()
        for i in range(3, len(b)):
            grams[int.from_bytes(b[i - 3 : i + 1], "big")] += 1
    model = langid.Model(["l"], np.zeros(len(grams), np.int64), np.array(list(grams)), np.array(list(grams.values()), float))

    def cost(context, symbol):
        p = 1.0
        for depth in (3, 2, 1, 0):
            tail = context[len(context) - depth :]
            seen = collections.Counter()
            for g, n in grams.items():
                b = g.to_bytes(4, "big")
                if b[3 - depth : 3] == tail:
                    seen[b[3]] += n
            if seen:
                total = sum(seen.values()) + len(seen)
                if seen[symbol]:
                    return -math.log2(p * seen[symbol] / total)
                p *= len(seen) / total
        return -math.log2(p / 256)

    asked = ["abra", "zzz", "", "dab é"]
    want = [sum(cost((bytes(3) + t.encode())[i : i + 3], t.encode()[i]) for i in range(len(t.encode()))) for t in asked]
    assert np.allclose(model.bits(pa.array(asked))[:, 0], want, rtol=1e-5)


def test_site_lines(spark):
    r = random.Random(2)
    rows = []
    for i in range(90):
        body = [f"line {r.randrange(200)}" for _ in range(5)] + ["", " menu  "] * (i % 2) + (["rare footer"] if i % 30 == 0 else [])
        rows.append((i, "\n".join(body), "en", [None, "a", "b"][i % 3], 0))
    rows += [(500, None, "en", "a", 0), (501, "menu\nmenu", "en", "a", 0), (501, "menu\nmenu", "en", "a", 0), (502, "", "en", "lonely", 0)]
    docs = spark.createDataFrame(rows, DOC)
    hosts = collections.Counter(x[3] for x in rows)
    seen = collections.Counter((x[3], k) for x in rows for k in {y.strip() for y in (x[1] or "").split("\n")} if k)
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.08 * hosts[k[0]]}
    want = []
    for i, t, *_ in rows:
        host = next(x[3] for x in rows if x[0] == i)
        keep = [y for y in (t or "").split("\n") if (host, y.strip()) not in bad]
        want.append((i, None if t is None else "\n".join(keep), 0 if t is None else len(t.split("\n")) - len(keep)))
    got = [(x.doc_id, x.text, x.n_dropped) for x in site_lines.drop_boilerplate(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(n for _, _, n in want)


def test_decontamination(spark):
    item = "A farmer named Alice has 12 sheep and 30 kg of wool so how much wool does Alice get from 12 sheep in 4 days at this rate"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, item.upper())], "item_id bigint, text string")
    again = item.replace("Alice", "Robert").replace("12", "50").replace("30", "1,700").replace(" 4 ", " 9 ")
    broken = item.replace("named Alice", "named Robert").replace("12 sheep and", "50 sheep and")  # one value, two stand-ins
    texts = ["some words before. " + item + " and some after", "Intro, " + again + ".", "now " + broken, "A farmer named Zoe likes it", None, "", item[:40], "word " * 30000 + item]
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table(spark, texts), items).collect()}
    assert rows[0, 1].kind == "verbatim" and rows[1, 1].kind == "reparameterised" and (7, 1) in rows
    assert rows[1, 1].n_slots >= 4 and {d for d, _ in rows} <= {0, 1, 2, 7}
    assert (2, 1) not in rows or rows[2, 1].kind == "verbatim"
    left = {r.doc_id for r in decontaminate.drop_leaking(table(spark, texts), items.where("item_id = 1")).collect()}
    assert {3, 4, 5, 6} <= left and not left & {0, 1, 7}


def test_patterns_look_for_capital_or_digit_first_and_find_the_same(spark):
    F = decontaminate.F
    plain = {  # as one would write them, with what is before looked at everywhere
        "_NAME": r"(?<=[\p{Ll}\p{N},;:] )\p{Lu}\p{Ll}+",
        "_FIRST": rf"(?<![\p{{L}}\p{{N}}\x01'’-])(?!(?:{decontaminate.OPENERS})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+",
        "_MEASURE": rf"(?i)\b{decontaminate._VALUE}\s?(%|(?:{decontaminate.UNITS})\b)",
        "_NUMBER": rf"(?<![\x02\x04\d\p{{L}}]){decontaminate._VALUE}\b",
    }
    r = random.Random(6)
    bits = ["The ", "Anna", "anna ", "É", "é", " Bo", ", ", ": ", "'", "-", "7", "12", "\x04", "\x02", " km", "%", "KG ", "\U00010400\U00010428", "x", ". ", "", " ", "\x01"]
    texts = spark.createDataFrame([("".join(r.choice(bits) for _ in range(25)),) for _ in range(2000)], "t string")
    for name, pattern in plain.items():
        now = getattr(decontaminate, name)
        assert re.match(r"(\(\?i\))?\(\?=\\(p\{Lu\}|d)\)", now)
        assert texts.where(F.regexp_replace("t", now, "<$0>") != F.regexp_replace("t", F.lit(pattern), F.lit("<$0>"))).count() == 0
        assert texts.where(F.regexp_replace("t", now, "<$0>") != F.col("t")).count() > 20


def test_window_hashes_are_those_of_arrays_and_copy_none(spark):
    F = decontaminate.F
    held = decontaminate._readings(spark.createDataFrame([(1, [*"abcdefg", "\x01bo", "\x05cy", "\x024", "h", "i"])], "doc_id long, w array<string>"), "doc_id", True)
    got = {(x.at, x.h) for x in held.select(F.explode(decontaminate._windows(True, 6)).alias("x")).select("x.*").collect()}
    want = {(i, x.h) for i in range(7) for x in held.select(F.xxhash64(F.slice("ht", i + 1, 6)).alias("h")).collect()}
    assert got == want
    for windows in (decontaminate._windows(True, 6), decontaminate._windows(False, 6)):
        assert "slice" not in str(windows)


def test_decontamination_meets_an_edited_item_at_every_offset(spark):
    short = "each farmer keeps seven brown sheep near water and sells white wool every single spring"
    assert len(short.split()) == 15
    edited = " ".join("old" if i == 7 else w for i, w in enumerate(short.split()))
    tom = "Tom has 3 apples. Tom buys 5 pears. Tom eats 2 apples at home. How many apples and pears does he have left"
    eve = tom.replace("Tom", "Eve").replace(" 3 ", " 40 ").replace(" 5 ", " 17 ")
    tiny = "name our largest ocean"
    items = spark.createDataFrame([(1, short), (2, tom), (3, tiny), (4, "too short"), (5, "Sheep eat grass. Cows eat hay. Pigs eat corn.")], "item_id bigint, text string")
    texts, want = [], {}
    for offset in range(8):
        before = " ".join(f"filler{j}" for j in range(offset))
        for item, body in ((1, edited), (1, short), (2, eve), (2, tom), (3, tiny), (5, "sheep eat grass cows eat hay pigs eat corn"), (5, "Sheep eat grass. Cows eat hay. Pigs eat corn.")):
            want[len(texts)] = item
            texts.append(f"{before}. {body} and nothing else" if offset else body)
    texts += ["name our largest lake", "too short", "Tom likes it. Tom sleeps."]
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(table(spark, texts), items).collect()}
    assert set(rows) == set(want.items())
    assert {rows[k].kind for k in rows if k[1] == 2 and "Eve" in texts[k[0]]} == {"reparameterised"}
    assert {rows[k].kind for k in rows if k[1] != 2 or "Tom" in texts[k[0]]} == {"verbatim"}
    assert {r.n_matched for r in rows.values() if r.item_id == 1} == {14, 15}


def test_items_of_values_are_met_as_written(spark):
    """Random items of numbers, units, names and few words: every copy is met, wherever it stands."""
    r = random.Random(12)
    pieces = ["{n}", "{n} kg", "{n}%", "${n}", "x", "and", "=", "+", "Zoe", "Max", "Ann"]
    sums = ["12 + 30 = 42 and 15 + 7 = 22 and 9 + 9 = 18", "Compute 12 x 30", "3 4 5"]
    while len(sums) < 40:
        text = " ".join(r.choice(pieces) for _ in range(r.randint(4, 16))).replace("{n}", "#")
        while "#" in text:
            text = text.replace("#", str(r.randint(2, 9999)), 1)
        sums.append("Solve " + text)
    items = spark.createDataFrame(list(enumerate(sums)), "item_id bigint, text string")
    many = {i for i, n in spark.range(1).select(*[decontaminate.F.size(decontaminate.words(decontaminate.F.lit(t))).alias(f"c{i}") for i, t in enumerate(sums)]).first().asDict().items() if n >= 3}
    many = {int(i[1:]) for i in many}
    assert len(many) > 30 and {0, 1, 2} <= many
    texts, home = [], {}
    for i, t in enumerate(sums):
        for before in ("", "note this: ", "plain words that go on for a while; "):
            home[len(texts)] = i
            texts.append(f"{before}{t}. Then more plain words follow here" if before else t)
    texts += ["Compute 14 x 31", "13 + 31 = 44 and 16 + 8 = 24 and 8 + 8 = 16", "3 4", None, "", " ".join(str(i * 7919 % 104729) for i in range(30000))]
    rows = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(table(spark, texts), items).collect()}
    for d, i in home.items():
        assert i not in many or rows[d, i].kind == "verbatim", (texts[d], i)
    assert not {d for d, _ in rows} & set(range(len(home), len(texts)))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_plain_pii_is_what_the_patterns_find():
    r = random.Random(7)
    bits = ["a.b@c.de", "@", "x@y", "@@a@b.c", "1.2.3.4", "300.1.1.1", "0010.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "é", " ", "\n", "word", ".", "-", "7" * 30, "%+-@q.r.s"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 9)))
        assert pii.plain(text) == brute_pii(text), text


@pytest.mark.parametrize("text, found", [
    ("write to jane [at] corp (dot) com today", ("email", "jane [at] corp (dot) com")),
    ("write to jane at corp dot com today", ("email", "jane at corp dot com")),
    ("jаne@cоrp.com", ("email", "jаne@cоrp.com")),
    ("call +1 five five five one two three four five now", ("phone", "+1 five five five one two three four five")),
    ("host １０.0.0.１ is up", ("ip", "１０.0.0.１")),
    ("4111​1111​1111​1111", ("card", "4111​1111​1111​1111")),
    ("mail jane at " + "h" * 200 + " dot com now", ("email", "jane at " + "h" * 200 + " dot com")),
    ("mail jane at a.b dot " + "c" * 200 + " dot com", ("email", "jane at a.b dot " + "c" * 200 + " dot com")),
    ("mail jane dot doe at corp dot co dot uk", ("email", "jane dot doe at corp dot co dot uk")),
    ("schreib an jana (ät) firma (Punkt) de", ("email", "jana (ät) firma (Punkt) de")),
    ("schreib an jana at firma punkt de heute", ("email", "jana at firma punkt de")),
    ("luis arroba empresa punto es", ("email", "luis arroba empresa punto es")),
    ("luc arobase maison point fr", ("email", "luc arobase maison point fr")),
    ("ruf +4 neun eins sieben sechs fünf vier drei zwo an", ("phone", "+4 neun eins sieben sechs fünf vier drei zwo")),
    ("tel +3 trois un deux quatre cinq zéro huit neuf", ("phone", "+3 trois un deux quatre cinq zéro huit neuf")),
    ("server 10 dot 0 dot 0 dot 7 is up", ("ip", "10 dot 0 dot 0 dot 7")),
    (" " * 50000 + "jane (at) corp (dot) com", ("email", "jane (at) corp (dot) com")),
])
def test_disguises_map_back_to_the_source(text, found):
    base, more = pii.find_pii(text)
    assert [(k, text[s:e]) for k, s, e in more] == [found], (base, more)


@pytest.mark.parametrize("text", ["meet me at noon. dot the i", "we met at home and one two three went", "at dot at dot", "one, two, three little pigs", "", "look at this point in the text", "un, deux, trois", "dos punto uno", "a dot " * 20000])
def test_plain_sentences_are_left_alone(text):
    assert pii.find_pii(text) == ([], [])


def test_many_disguises_in_one_text():
    one = "x at y dot org, "
    base, more = pii.find_pii(one * 20000)
    assert base == [] and more == [("email", len(one) * i, len(one) * (i + 1) - 2) for i in range(20000)]


def test_the_prefilter_lets_every_disguise_through(spark):
    r = random.Random(9)
    bits = ["jane", "corp", "com", "a-b", "x_1", "at", "dot", "@", ".", "(at)", "[dot]", "{ . }", "< @ >", "one", "Five", "zero", "oh", "fünf", "deux", "ocho", "punkt", "arroba", "punto", "arobase", "point", "ät", "7", "+1", ",", "-", "é", "е", "４", "", "–"]
    texts = ["write to jane@corp dot com", "mail jane at mail.corp dot com", "mail jane AT corp\tDOT com", "jane [at] corp (dot) com", "jane at corp dot com", "jаne@cоrp.com",
             "call +1 five five five one two three four five now", "host １０.0.0.１ is up", "4111​1111​1111​1111"]
    hits = len(texts)
    texts += ["".join(r.choice(bits) + r.choice(["", " ", " ", "\t"]) for _ in range(r.randint(2, 14))) for _ in range(4000)]
    rows = {x.doc_id: x for x in pii.detect(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base, more = pii.find_pii(t)
        assert rows[i].n_added == len(more) and set(rows[i].spans.split(",")) == {f"{k}:{s}:{e}" for k, s, e in base + more} | ({""} if not base + more else set()), t
        assert more or i >= hits, t


def test_pii_rows(spark):
    texts = ["mail a@b.co or +1 (017) 555-7713", None, "", "a@b.co " * 30000, "x (at) y (dot) org"]
    rows = {r.doc_id: r for r in pii.detect(table(spark, texts)).collect()}
    assert rows[0].spans == "email:5:11,phone:15:32" and rows[0].n_email == 1 and rows[3].n_email == 30000
    assert rows[0].base_sha256 == hashlib.sha256(rows[0].spans.encode()).hexdigest()
    assert rows[4].spans == "email:0:18" and rows[4].n_added == 1 and rows[4].n_email == 0 and rows[4].base_sha256 == rows[1].base_sha256
    assert rows[1].spans == rows[2].spans == ""


def test_vafile(spark):
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # ties
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, []), (600, [0.5] * 3), (650, [1e6] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in vafile.top_k(df, df["vec_id"] % 50 == 0, query_block=4, data_block=64).collect()}
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in good:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores)}
    assert got == want
    assert vafile.top_k(df.limit(0), df["vec_id"] % 50 == 0).count() == 0


def test_url_rules(spark):
    link = '<link rel="canonical" href="%s">'
    rows = [
        (1, "https://WWW.a.com/x?q#f", link % "https://spam.org/bad/1"), (2, "http://spam.org/bad/1", None), (3, "http://other.org/", '<meta http-equiv="refresh" content="0; url=//www.a.com/x?q">'),
        (4, None, None), (5, "no scheme", link % "/x"), (6, "http://ok.org/a", link % "http://spam.org/bad/2"), (7, "http://good.org/1", link % "http://ok.org/a"),
        (8, "http://x.org", ""), (9, "http://x.org", ""), (10, "http://sub.spam.org/bad/", "<p>canonical</p>"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", url_rules.F.lit("clash"))
    rules = url_rules.rule_table(spark, [("block", "spam.org", "/bad/"), ("allow", "good.org", "/"), ("allow", "spam.org", "/")])
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages, rules).collect()}
    assert got[1] == ("www.a.com", "/x", None, "block") and got[3][3] == "block" and got[2] == ("spam.org", "/bad/1", "spam.org/bad/", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == (None, "allow") and got[7][2:] == ("good.org/", "allow")  # an alias is explicitly allowed
    assert got[8] == got[9] == ("x.org", "", None, "allow") and got[10][3] == "block"


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOC)
    items = spark.createDataFrame([], "item_id bigint, text string")
    for df in (ngram_join.join(empty), repeats.digest(repeats.remove_repeats(empty)), passages.passages(empty), packing.pack(empty, tokenizer_path()),
               langid.identify(empty, ~held_out()), site_lines.drop_boilerplate(empty), decontaminate.leaks(empty, items), pii.detect(empty)):
        assert df.count() == 0
    clash = "doc_id node n _id token_ bad gone _drop n_dropped host _text score lang_pred h g at src a b".split()
    rows = [(1, "a b c d e f " * 20, "en", "s", 0, *[None] * (len(clash) - 1))] * 1 + [(2, "q r s t u v " * 20, "en", "s", 0, *["x"] * (len(clash) - 1))]
    docs = spark.createDataFrame(rows, DOC + "".join(f", `{c}` string" for c in clash[1:]))
    assert ngram_join.keep_one(docs).columns == docs.columns and ngram_join.keep_one(docs).count() == 2
    assert decontaminate.drop_leaking(docs, items).columns == docs.columns
    assert site_lines.drop_boilerplate(docs).columns == docs.columns + ["_n_dropped"]
    for df in (repeats.digest(repeats.remove_repeats(docs)), packing.pack(docs, tokenizer_path()), pii.detect(docs), langid.identify(docs, ~held_out()), ngram_join.join(docs)):
        assert df.count() == 2
    assert passages.passages(docs).count() == 0


def test_near_copies_do_not_depend_on_the_rounds_their_differences_are_worked_out_in(spark, monkeypatch):
    r = random.Random(17)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(r.choice([x, x, x, x, x, x, x, x, x, x, x, x, x, x, x, x, x, x, x, f"v{r.randrange(400)}"]) for x in base) for _ in range(90)]
    texts += [" ".join(f"u{j}x{i}" for i in range(60)) + f" end{k}" for j in range(9) for k in range(3)]
    docs = table(spark, texts)
    want = {x.doc_id: x.component_id for x in ngram_join.join(docs).collect()}
    assert len(set(want.values())) > 9
    shuffled, pin = [], ngram_join.pin
    monkeypatch.setattr(ngram_join, "ROUND_TOKENS", 1000)
    monkeypatch.setattr(ngram_join, "pin", lambda df, *a, **k: shuffled.append("delta" in df.columns) or pin(df, *a, **k))
    assert {x.doc_id: x.component_id for x in ngram_join.join(docs).collect()} == want
    assert sum(shuffled) > 4  # the differences came in several parts
