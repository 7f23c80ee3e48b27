"""Exact substring dedup by longest-previous-factor arrays.

Think of all texts, in order of id, as one suffix array that no match may leave a text in. A position
is the start of a repeat if its longest previous factor (LPF) has at least ``LENGTH`` bytes; LPF is the
longer of the common prefixes with the previous and the next smaller position in suffix order. Only
whether LPF reaches LENGTH matters, so suffixes are ordered by their first LENGTH bytes (by a hash of
them, any order of distinct strings will do) and then by position. In a run of suffixes with one
LENGTH-byte prefix the previous smaller position is the row before, the next smaller one lies outside
the run: every row of a run but its first is a repeat.

Not every position is sorted on its own. Of the K-byte grams in a window of LENGTH bytes the leftmost
smallest one, by hash, is its anchor; equal windows have equal anchors at equal places. Neighbouring
windows with one anchor are a stretch. Whole stretches are sorted first, by what their windows have in
common (the anchor) and then by content: a stretch like an earlier one repeats in full; one whose anchor
occurs nowhere else has no repeat; those that share an anchor but differ are cut into pieces of ``PIECE``
windows, at places fixed by the anchor, and sorted again by the longer common part; what is still open
then is sorted window by window.

Each batch collapses equal stretches before the shuffle, so copies of one text reach a task as a few
rows per batch. Common part and content are compared by 64 bits of hash each, windows by 128.

Defined cases: a null text is empty; texts shorter than LENGTH have no repeat; ids must be unique, rows
with a null id are left out; equal windows inside one text repeat its own earlier ones, overlapping or
not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberwatch.llm.arrow import PIECE_BYTES, bounded, chunks, ints, minima, mix, signed, span_hashes, utf8
from emberwatch.plans.lineage import pin

#: Bytes of a match, and of the grams that anchor it.
LENGTH, GRAM = 100, 32
#: Windows of a piece in the second round.
PIECE = 10
_OTHER = 0xC2B2AE3D27D4EB4F
#: What a row of stretches says: to be sorted, or a repeat for certain.
SORT, SURE = 0, 1


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, start, windows, anchor, anchor hash, content hashes) of all stretches, in text order.

    ``start`` is the place of the first window in the buffer, ``windows`` how many follow each other,
    ``anchor`` the place of their anchor.
    """
    n, w = len(data) - gram + 1, length - gram + 1
    empty = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 3
    if len(data) < length:
        return empty
    at = np.arange(n)
    grams = span_hashes(data, at, at + gram)
    best = minima(grams, w)  # per window start in the whole buffer
    start = np.arange(len(best))
    row = np.searchsorted(offsets, start, side="right") - 1
    inside = start + length <= offsets[row + 1]
    start, row, best = start[inside], row[inside], best[inside]
    if not len(start):
        return empty
    first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
    windows = np.diff(np.append(first, len(start)))
    s = start[first]
    e = s + windows - 1 + length
    return row[first], s, windows, best[first], grams[best[first]], span_hashes(data, s, e), span_hashes(data, s, e, _OTHER)


def _pack(at: np.ndarray, anchor: np.ndarray, windows: np.ndarray, kind) -> np.ndarray:
    """Start of the first window, its distance to the anchor, number of windows, kind."""
    return (at.astype(np.int64) << 17) | (anchor.astype(np.int64) << 9) | (windows.astype(np.int64) << 1) | kind


def _start(place):
    return place >> 17


def _count(place):
    return (place >> 1) & 255


def _rows(common: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """A batch to be sorted; of equal contents all but the first are certain repeats."""
    order = np.lexsort((place, doc, content, common))
    common, content, doc, place = common[order], content[order], doc[order], place[order]
    again = np.concatenate([[False], (common[1:] == common[:-1]) & (content[1:] == content[:-1])])
    # a certain repeat travels under a key of its own
    common = np.where(again, mix(doc.view(np.uint64) ^ place.view(np.uint64) << np.uint64(20)), common)
    return pa.RecordBatch.from_arrays([signed(common), signed(content), pa.array(doc), pa.array(place | again)], ["anchor", "content", "doc_id", "place"])


SORTED = "anchor bigint, content bigint, doc_id bigint, place bigint"


def anchored(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, content, doc_id, place) of every stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            parts = []
            for piece in chunks(iter([batch]), "text", PIECE_BYTES):
                data, offsets = utf8(piece.column("text"))
                row, start, windows, at, anchor, one, two = stretches(data, offsets, length, gram)
                parts.append((anchor, mix(one ^ mix(two)), ints(piece, "doc_id")[row], _pack(start - offsets[row], at - start, windows, SORT)))
            rows = [np.concatenate(x) for x in zip(*parts)]
            if len(rows[0]):
                yield _rows(*rows)

    return docs.mapInArrow(run, SORTED)


def _pieces(texts: DataFrame, length: int, width: int) -> DataFrame:
    """The stretches in ``places`` of a text, cut where the distance to the anchor is a multiple of ``width``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            parts = []
            for piece in chunks(iter([batch]), "text", PIECE_BYTES):
                data, offsets = utf8(piece.column("text"))
                lists = piece.column("places")
                bounds, place = lists.offsets.to_numpy(), lists.values.to_numpy()
                row = np.repeat(np.arange(piece.num_rows), np.diff(bounds))
                place = place[bounds[0] : bounds[-1]]
                far = (place >> 9) & 255  # of the first window; the following ones are nearer to the anchor
                near = far - _count(place) + 1
                n = far // width - near // width + 1
                each = np.repeat(np.arange(len(place)), n)
                k = (far // width)[each] - (np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n))
                top, low = np.minimum(far[each], k * width + width - 1), np.maximum(near[each], k * width)
                anchor = (_start(place) + far + offsets[row])[each]
                row = row[each]
                first, last = anchor - top, anchor - low
                common = span_hashes(data, anchor - k * width, anchor - k * width - width + 1 + length)
                content = span_hashes(data, first, last + length, _OTHER)
                doc = ints(piece, "doc_id")[row]
                parts.append((common, content, doc, _pack(first - offsets[row], top, top - low + 1, SORT)))
            yield _rows(*[np.concatenate(x) for x in zip(*parts)])

    return texts.mapInArrow(run, SORTED)


def _sorted_stretches(rows: DataFrame) -> DataFrame:
    """(doc_id, place): kind SURE for stretches that repeat in full, SORT for those that must be cut further.

    Only the last row, and one undecided first stretch of an anchor, are carried from batch to batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "content", "doc_id", "place")
        held = {k: np.zeros(0, np.int64) for k in names}  # the last anchor's first row so far
        last = None  # (anchor, content) of the row before
        several = False  # whether the last anchor is known to have different contents

        def out(doc, place):
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place)], ["doc_id", "place"])

        for batch in batches:
            col = {k: ints(batch, k) for k in names}
            sure = (col["place"] & 1) == SURE
            if sure.any():
                yield out(col["doc_id"][sure], col["place"][sure])
                col = {k: v[~sure] for k, v in col.items()}
            if not len(col["anchor"]):
                continue
            a, c = col["anchor"], col["content"]
            pa_, pc_ = np.roll(a, 1), np.roll(c, 1)
            same_a, same_c = a == pa_, (a == pa_) & (c == pc_)
            same_a[0], same_c[0] = last is not None and last[0] == a[0], last == (a[0], c[0])
            if same_c.any():
                yield out(col["doc_id"][same_c], col["place"][same_c] | SURE)
            fresh = ~same_c  # first of its content
            other = fresh & same_a  # the anchor already had another content
            if other.any():
                yield out(col["doc_id"][other], col["place"][other])
            # the first stretch of an anchor is to be sorted if another content follows
            heads = np.flatnonzero(~same_a)
            follows = np.add.reduceat(other, heads) > 0 if len(heads) else np.zeros(0, bool)
            lead = other[: heads[0]].any() if len(heads) else other.any()
            if lead and not several and len(held["anchor"]):
                yield out(held["doc_id"], held["place"])
                several = True
            if len(heads):
                pick = heads[follows]
                if len(pick):
                    yield out(col["doc_id"][pick], col["place"][pick])
                held = {k: v[heads[-1:]] for k, v in col.items()}
                several = bool(follows[-1])
            last = (a[-1], c[-1])

    return rows.repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id", "place").mapInArrow(run, "doc_id bigint, place bigint")


def _spans(place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the bytes that the windows in ``place`` cover."""
    start = _start(place)
    order = np.argsort(start)
    start, end = start[order], (start + _count(place) - 1 + length)[order]
    end = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1] if len(first) else end


def _open(found: DataFrame) -> DataFrame:
    """(_id, places) of the documents with undecided stretches; at most one place per byte of a text."""
    return found.where("place & 1 = 0").groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("place").alias("places"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, places): per document with a repeat its windows, packed."""
    d = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    found = pin(_sorted_stretches(anchored(d, length, gram)), release=True)
    rounds = [found]
    for width in (PIECE, 1):
        open_ = _open(rounds[-1])
        # the texts are read again only for what is open; the second time only those of the first
        d = pin(d.join(open_, d["doc_id"] == open_["_id"]).select("doc_id", "text", "places"), release=True)
        rounds.append(pin(_sorted_stretches(_pieces(d, length, width)), release=True))
        d = d.select("doc_id", "text")
    every = rounds[0].unionByName(rounds[1]).unionByName(rounds[2]).where("place & 1 = 1")
    return every.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of removed bytes), kept (binary: the remaining bytes) of every row."""
    places = repeats(docs, doc_id, text, length, gram)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc_id is not null")
    joined = d.join(places.withColumnRenamed("doc_id", "_id"), d["doc_id"] == F.col("_id"), "left").select("doc_id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            data, offsets = utf8(batch.column("text"))
            lists = batch.column("places")
            spans, kept = [], []
            for i in range(batch.num_rows):
                body, place = data[offsets[i] : offsets[i + 1]], lists[i].values
                if place is None:
                    spans.append([])
                    kept.append(body.tobytes())
                    continue
                start, end = _spans(place.to_numpy(), length)
                marks = np.zeros(len(body) + 1, np.int8)
                marks[start] += 1
                marks[end] -= 1
                keep = np.cumsum(marks, dtype=np.int8)[:-1] == 0
                spans.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist())])
                kept.append(body[keep].tobytes())
            span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """The counts and the hash of what ``remove_repeats`` keeps."""
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
