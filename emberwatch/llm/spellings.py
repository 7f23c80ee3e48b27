"""Spelling variants: words one inserted, deleted or replaced letter apart, grouped under their frequent form.

A word's letters are a multiset, seen as a binary vector with one place per (letter, how many before it).
One edit changes at most two places, so near words have vectors of Hamming distance at most two. PartEnum
finds all such pairs exactly: the places are dealt into ``PARTS`` partitions, and for every choice of
``PARTS`` - 2 of them the part of the vector that lies there is a signature. Two differing places spoil at
most two partitions, so one signature is shared. Signatures are joined by equality and every pair met is
verified by its edit distance. As anagrams share all signatures, a signature also carries one half of the
word: a single edit leaves the first or the last half of the shorter word's length as it is.

All steps are joins and grouped sums on words; a word has 4 * C(PARTS, 2) short rows whatever its frequency.
Forms are followed to their ends by pointer doubling: a form is at least twice as frequent as its word, so
there are no cycles and at most log2(log2(n)) rounds.

Defined cases: a null or empty text has no runs; a null id counts as an empty one in the checksum; repeated
rows count each; without any word the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.llm.arrow import mix, signed, utf8
from emberwatch.plans.lineage import pin

#: Partitions of the letter vector; any two of them may differ.
PARTS = 4
#: Least code points and least occurrences of a word; how much more frequent a form must be.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 5, 3, 2
#: One in so many (document, run) loses a letter.
DAMAGE = 97
_RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, doc_id: Column) -> Column:
    """The run, less one letter where the checksum of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", damage: bool = True) -> DataFrame:
    """(word, n): the words of all texts, counted."""
    runs = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(_RUN), F.lit(0))).alias("run"))
    word = damaged(F.col("run"), F.col("doc_id")) if damage else F.col("run")
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words and where each word begins."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(column) + 1, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, leads[offsets]


def _prefix_hashes(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch of a word follows: place-weighted, modulo 2**64."""
    inside = np.arange(len(points)) - np.repeat(begins[:-1], np.diff(begins))
    powers = np.ones(int(inside.max(initial=0)) + 2, np.uint64)
    powers[1:] = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(powers)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64)) * powers[inside], dtype=np.uint64)])


def _signatures(words: DataFrame, parts: int) -> DataFrame:
    """(key, whole, word, n): per word every signature, for its own length (``whole``) and for being the longer one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drops = list(combinations(range(parts), 2))
        for full in batches:
            for start in range(0, full.num_rows, 4096):
                batch = full.slice(start, 4096)
                words_in, n = batch.column("word"), batch.column("n")
                points, begins = _points(words_in)
                row = np.repeat(np.arange(batch.num_rows), np.diff(begins))
                order = np.lexsort((points, row))
                letter = points[order]
                first = np.ones(len(letter), bool)
                first[1:] = (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])
                at = np.arange(len(letter))
                place = mix(letter.astype(np.uint64) << np.uint64(32) | (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64))
                part = (place >> np.uint64(40)) % np.uint64(parts)
                sums = np.zeros((batch.num_rows, parts), np.uint64)
                np.add.at(sums, (row, part.astype(np.int64)), mix(place + np.uint64(1)))
                prefix = _prefix_hashes(points, begins)
                length = np.diff(begins)
                for k, drop in enumerate(drops):
                    sig = np.full(batch.num_rows, k + 1, np.uint64)
                    for p in range(parts):
                        if p not in drop:
                            sig = mix(sig + sums[:, p])
                    for less in (0, 1):
                        short = length - less
                        half = short // 2
                        head = prefix[begins[:-1] + half] - prefix[begins[:-1]]
                        # the last short - half letters, hashed from their own first place
                        tail = _tail_hash(points, begins, short - half)
                        for side, piece in ((0, head), (1, tail)):
                            key = mix(mix(sig ^ mix(piece + np.uint64(side))) + short.astype(np.uint64))
                            yield pa.RecordBatch.from_arrays([signed(key), pa.array(np.full(batch.num_rows, not less)), words_in, n], ["key", "whole", "word", "n"])

    return words.mapInArrow(run, "key bigint, whole boolean, word string, n bigint")


def _tail_hash(points: np.ndarray, begins: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the last ``size`` letters of every word, the same for equal letters whatever stands before."""
    back = np.repeat(begins[1:], np.diff(begins)) - 1 - np.arange(len(points))
    powers = np.ones(int(back.max(initial=0)) + 2, np.uint64)
    powers[1:] = np.uint64(0xD6E8FEB86659FD93)
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64)) * powers[back], dtype=np.uint64)])
    return sums[begins[1:]] - sums[begins[1:] - size]


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(a, b, na, nb), once per pair of words with a < b that are one edit apart."""
    rows = _signatures(words, parts)
    a = rows.select("key", F.col("whole").alias("wa"), F.col("word").alias("a"), F.col("n").alias("na"))
    b = rows.select("key", F.col("whole").alias("wb"), F.col("word").alias("b"), F.col("n").alias("nb"))
    # One of the two has the length of the key, that of the shorter word. Spark sizes the signatures as if each word had one,
    # and so would broadcast some that no driver can hold; this goes for all joins here, which grow with the vocabulary.
    met = a.join(b.hint("merge"), (a["key"] == b["key"]) & (a["a"] < b["b"]) & (a["wa"] | b["wb"]) & (F.levenshtein("a", "b", 1) == 1))
    return met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of a word end, by doubling the steps in each round."""
    now = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = pin(now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """Per word of ``words`` (word, n): form, root, n, n_near, form_n."""
    words = pin(words)
    pairs = near_pairs(words, parts)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("near_n")))).alias("p")).select("p.*")
    # the most frequent near word, the least one in byte order (that of code points) among equals
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = pin(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(-F.col("best.less") >= FORM_RATIO * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.less") >= FORM_RATIO * F.col("n"), -F.col("best.less")).alias("form_n")))
    roots = _roots(told.where("form is not null"))
    return told.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
