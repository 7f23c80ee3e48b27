"""Document quality by Bradley-Terry ranking of labelled documents.

Each text becomes a short vector of shares and averages. From the labelled documents preference pairs are
made, a good one before a bad one; the model gives a document the strength w.x, so that a wins over b with
probability 1 / (1 + exp(-w.(xa - xb))), and w minimises the logistic loss on the differences. The cut is a
quantile of the strengths: as large a share of the labelled documents lies below it as is labelled bad. A
score is the probability of winning against a document at the cut, shifted so that the cut scores ``CUT``.

Features are computed in one pass over the texts, in tasks, and written as a narrow table that training and
scoring read. Every labelled document takes part in the fit: either label is numbered in the order of a hash, and
each document of the larger one is paired with ``PAIRS`` / its size (rounded up, one at least) successive ones of the
other, in a ring; with few labels these are all pairs. Slope and curvature of a Newton step are sums over the tasks
that hold the pairs, and the cut lies between two places of the sorted strengths of all labelled documents.

Defined cases: a null text is empty; an empty text has the features zero and a score like any other; rows
without a label, with another label than 0 and 1 or without an id train nothing; an id labelled both ways is
bad; repeated rows count each; with only one kind of label all strengths are equal and all scores are 0.5;
a null id is not held out. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.llm.arrow import chunks, lower, span_hashes, utf8, words
from emberwatch.operators.scan import running_sum
from emberwatch.plans.lineage import pin

#: The fit makes at least so many preference pairs, or all there are.
PAIRS = 100_000
#: The score of a document at the cut.
CUT = 0.3
#: Weight of the penalty on w, for standardised features.
RIDGE = 1e-3

_BYTES = np.arange(256)
_KINDS = {  # byte classes whose share of a text is a feature
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "space": (_BYTES == 32) | (_BYTES == 9),
    "line": _BYTES == 10,
    "stop": np.isin(_BYTES, list(b".,;:'\"-")),
    "shout": np.isin(_BYTES, list(b"!?")),
    "bar": np.isin(_BYTES, list(b"|<>{}[]()\\/")),
    "sign": np.isin(_BYTES, list(b"#$%&*+=@^_`~")),
    "wide": _BYTES >= 128,
    "control": (_BYTES < 32) & ~np.isin(_BYTES, [9, 10, 13]),
}
_SHARES = (*_KINDS, "twin", "repeated", "loud", "marked", "letterless")
FEATURES = (*(f"{x}_share" for x in _SHARES), *(f"{x}_root" for x in _SHARES), "length", "word_length", "spread", "has_text")
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_MARKS = _KINDS["sign"] | _KINDS["bar"] | _KINDS["shout"]


def _vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    counts = np.zeros((n, 256))
    for at in range(0, n, 512):  # the histogram of a piece of rows at a time
        end = min(at + 512, n)
        piece = data[offsets[at] : offsets[end]]
        counts[at:end] = np.bincount((row[offsets[at] : offsets[end]] - at) * 256 + piece, minlength=(end - at) * 256).reshape(-1, 256)
    length = np.maximum(size, 1)[:, None]
    share = counts / length
    kinds = np.stack([share[:, mask].sum(1) for mask in _KINDS.values()], 1)
    spread = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    begin, end, of = words(data, offsets)
    total = np.maximum(np.bincount(of, minlength=n), 1)
    hashes = span_hashes(lower(data), begin, end)
    twin = np.zeros(len(of), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    again = np.zeros(len(of), bool)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    capitals = np.concatenate([[0], np.cumsum(_KINDS["upper"][data])])
    letters, capitals = letters[end] - letters[begin], capitals[end] - capitals[begin]
    flags = (twin, again, (letters > 1) & (capitals * 2 > letters), _MARKS[data[end - 1]] if len(end) else np.zeros(0, bool), letters == 0)
    rows = (of, of[order], of, of, of)
    by_word = np.stack([np.bincount(r[f], minlength=n) / total for r, f in zip(rows, flags)], 1)
    shares = np.concatenate([kinds, by_word], 1)
    others = np.stack([np.log1p(size), np.log1p(np.bincount(of, end - begin, minlength=n) / total), spread, (size > 0).astype(float)], 1)
    return np.concatenate([shares, np.sqrt(shares), others], 1)


def features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, one column per feature) for every row."""
    key = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            got = _vectors(*utf8(batch.column("text"))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(x)) for x in got.T)], ["doc_id", *FEATURES])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, ", ".join([f"doc_id {key}", *(f"{f} float" for f in FEATURES)]))


@dataclass
class Ranking:
    """Strength of a document: ``weights`` . features; ``cut`` is the strength that scores CUT."""

    weights: np.ndarray
    cut: float

    def strength(self) -> Column:
        return sum((F.col(f).cast("double") * float(w) for f, w in zip(FEATURES, self.weights)), F.lit(0.0))

    def score(self) -> Column:
        if not self.weights.any():
            return F.lit(0.5)
        return 1 / (1 + F.exp(-(self.strength() - self.cut) - float(np.log(CUT / (1 - CUT)))))


def preferences(ranked: DataFrame, bad: int, good: int, pairs: int) -> DataFrame:
    """(win, lose): feature arrays of pairs of (label, place from 1, x); every document is in a pair, those of a label about equally often."""
    larger, m, n = (0, good, bad) if bad > good else (1, bad, good)
    turns = min(m, -(-pairs // n))
    many = ranked.where(F.col("label") == larger).select("place", F.col("x").alias("a"))
    few = ranked.where(F.col("label") == 1 - larger).select((F.col("place") - 1).alias("at"), F.col("x").alias("b"))
    met = many.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).withColumn("at", (F.col("place") + F.col("at")) % m).join(few, "at")
    win, lose = ("a", "b") if larger else ("b", "a")
    return met.select(F.col(win).alias("win"), F.col(lose).alias("lose"))


def _slope_and_curve(differences: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the differences of the first and second derivatives of the loss."""
    lose = 1 / (1 + np.exp(np.clip(differences @ w, -500, 500)))
    return -differences.T @ lose, (differences * (lose * (1 - lose))[:, None]).T @ differences


def _newton(size: int, n: int, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], ridge: float) -> np.ndarray:
    w = np.zeros(size)
    for _ in range(30):
        slope, curve = sums(w)
        step = np.linalg.solve(curve / n + ridge * np.eye(size), slope / n + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def bradley_terry(differences: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of least logistic loss on the differences, by Newton steps."""
    return _newton(differences.shape[1], len(differences), lambda w: _slope_and_curve(differences, w), ridge)


def bradley_terry_table(pairs: DataFrame, n: int, scale: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """The same over a table of ``n`` pairs (win, lose); the differences are divided by ``scale``. A step is one pass, of which sums alone leave the tasks."""
    size = len(scale)

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + size * size)
            for batch in batches:
                win, lose = (batch.column(c).flatten().to_numpy().astype(float).reshape(-1, size) for c in ("win", "lose"))
                slope, curve = _slope_and_curve((win - lose) / scale, w)
                total += np.concatenate([slope, curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "v"])

        got = np.zeros(size + size * size)
        for r in pairs.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            got[r.i] = r.v
        return got[:size], got[size:].reshape(size, size)

    return _newton(size, n, sums, ridge)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To 9 digits, so that the order in which tasks are summed up does not show."""
    return np.array([float(f"{v:.8e}") for v in x])


def fit(labelled: DataFrame, pairs: int = PAIRS) -> Ranking:
    """Learn from (doc_id, features, label 0 or 1)."""
    rows = labelled.where("label in (0, 1)")
    seen = rows.agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good"), *[F.stddev_pop(f).alias(f) for f in FEATURES]).first()
    if not seen.bad or not seen.good:
        return Ranking(np.zeros(len(FEATURES)), 0.0)
    scale = _rounded(np.array([seen[f] for f in FEATURES]))
    scale[scale < 1e-9] = np.inf  # a feature that says nothing gets no weight
    order = ["_h", "doc_id"]
    numbered = running_sum(
        rows.select("label", "doc_id", F.array(*FEATURES).alias("x")).withColumns({"_h": F.xxhash64("doc_id", "x"), "_one": F.lit(1)}), "label", order, "_one", "place")
    met = pin(preferences(pin(numbered.select("label", "place", "x")), seen.bad, seen.good, pairs))
    w = _rounded(bradley_terry_table(met, met.count(), scale) / scale)
    # as many labelled documents as are labelled bad lie below the cut
    model = Ranking(w, 0.0)
    strengths = rows.select(model.strength().alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
    upto = running_sum(strengths, "_k", ["s"], "n", "upto")
    beside = upto.agg(*[F.min(F.when(F.col("upto") >= place, F.col("s"))) for place in (seen.bad, seen.bad + 1)]).first()
    return Ranking(w, (beside[0] + beside[1]) / 2)


def rank(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``held_out`` is a condition on ``doc_id`` whose rows' labels are not used."""
    table = pin(features(docs, text, doc_id).withColumn("held_out", F.coalesce(held_out, F.lit(False))))
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where("label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    model = fit(table.where(~F.col("held_out")).join(known, "doc_id"))
    return table.select("doc_id", "held_out", model.score().alias("score")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
