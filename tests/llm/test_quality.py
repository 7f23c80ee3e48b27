"""Quality ranking: held-out order, the fit against a plain optimiser, awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import quality

DOC = "doc_id bigint, text string, score double, label int, length int"

def fifth():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def corpus(seed, n=600):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnoprstuéü") for _ in range(r.randint(1, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.8
        w = [r.choice(words) for _ in range(r.randint(3, 200))]
        if not good:
            kind = r.randrange(4)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + r.choice(("###", "***")) for x in w] if kind == 1 else [w[0]] * len(w) if kind == 2 else " | ".join(w).split()
        docs.append((i, " ".join(w) + ".", 0.0, 0, 0))
        labels.append((i, int(good), 0))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, DOC).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_documents_are_ranked(spark):
    docs, labels = corpus(1)
    got = {r.doc_id: r for r in quality.rank(*tables(spark, docs, labels), fifth()).collect()}
    assert len(got) == len(docs)
    held = [(got[i].score, q, got[i].predicted) for i, q, _ in labels if got[i].held_out]
    assert len(held) > 80
    good, bad = [s for s, q, _ in held if q], [s for s, q, _ in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.99
    assert np.mean([p == q for _, q, p in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_held_out_labels_are_not_used(spark):
    docs, labels = corpus(2, 300)
    a, b = tables(spark, docs, labels)
    held = {r.doc_id for r in a.where(fifth()).collect()}
    turned = [(i, 1 - q if i in held else q, t) for i, q, t in labels]
    first = {r.doc_id: r.score for r in quality.rank(a, b, fifth()).collect()}
    assert first == {r.doc_id: r.score for r in quality.rank(*tables(spark, docs, turned), fifth()).collect()}


def test_the_fit_is_the_least_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5)) + [0.5, 0, -0.2, 0.1, 0]
    w = quality.bradley_terry(x, 0.01)

    def loss(v):
        return np.log1p(np.exp(-x @ v)).mean() + 0.005 * (v @ v)

    assert all(loss(w) <= loss(w + 1e-3 * d) for d in rng.normal(size=(50, 5)))


def test_all_labelled_documents_count(spark):
    """More documents than were looked at before: weights and cut are those of all of them."""
    n, m = 24_000, 12_500
    x = {f: F.lit(0.0).cast("float") for f in quality.FEATURES}
    x["length"] = (F.pmod(F.xxhash64("doc_id"), F.lit(10_007)) / 1000 + F.col("label")).cast("float")
    x["spread"] = F.when(F.col("doc_id") % 3 == 0, 1 - F.col("label")).otherwise(0).cast("float")
    rows = spark.range(n + m).withColumnRenamed("id", "doc_id").withColumn("label", (F.col("doc_id") >= m).cast("int")).withColumns(x)
    model = quality.fit(rows)
    got = np.sort([r[0] for r in rows.select(model.strength()).collect()])
    assert model.cut == pytest.approx((got[m - 1] + got[m]) / 2, abs=1e-9)
    assert quality.fit(rows.repartition(7)).weights.tolist() == model.weights.tolist()
    few = rows.where("doc_id between 12440 and 12560")  # here all pairs are made
    at = np.array([r[:] for r in few.select(*quality.FEATURES).collect()], float)
    kind = np.array([r[0] for r in few.select("label").collect()])
    scale = np.where(at.std(0) < 1e-9, np.inf, at.std(0))
    plain = quality.bradley_terry(np.concatenate([g - at[kind == 0] for g in at[kind == 1]]) / scale) / scale
    assert quality.fit(few).weights == pytest.approx(plain, abs=1e-6)


def test_features_of_pieces_equal_those_of_one_text(spark):
    docs, _ = corpus(3, 50)
    got = {r.doc_id: r for r in quality.features(spark.createDataFrame(docs, DOC)).collect()}
    for i, text, *_ in docs:
        words = text.split()
        assert got[i].twin_share == pytest.approx(sum(a.lower() == b.lower() for a, b in zip(words, words[1:])) / len(words), abs=1e-6)
        assert got[i].repeated_share == pytest.approx(1 - len({w.lower() for w in words}) / len(words), abs=1e-6)
        assert got[i].upper_share == pytest.approx(sum("A" <= c <= "Z" for c in text) / len(text.encode()), abs=1e-6)


def test_awkward_rows(spark):
    docs, labels = corpus(4, 200)
    docs += [(500, None, None, None, None), (501, "", 0.0, 0, 0), (None, "some text", 0.0, 0, 0), (502, "\n \t", 0.0, 0, 0), (503, "word " * 400_000, 0.0, 0, 0), (5, "second row", 0.0, 0, 0)]
    labels += [(500, 0, 0), (501, 1, 0), (None, 1, 0), (7, None, 0), (8, 5, 0), (9, 0, 0), (9, 1, 0)]
    rows = quality.rank(*tables(spark, docs, labels), fifth()).collect()
    assert len(rows) == len(docs) and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert len(by_id[5]) == 2 and by_id[None][0].held_out is False and by_id[500][0].score == by_id[501][0].score


def test_without_documents_or_labels(spark):
    docs, labels = corpus(5, 30)
    a, b = tables(spark, docs, labels)
    assert quality.rank(a.limit(0), b, fifth()).count() == 0
    assert {(r.score, r.predicted) for r in quality.rank(a, b.limit(0), fifth()).collect()} == {(0.5, 1)}
    assert {(r.score, r.predicted) for r in quality.rank(a, b.where("quality = 1"), fifth()).collect()} == {(0.5, 1)}
