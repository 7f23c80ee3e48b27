"""Best-fit packing of token sequences by exact complements.

Texts are tokenised whole; only sequences longer than the limit are cut, into pieces of the limit. The
plan is made from the histogram of piece lengths, which has at most ``limit`` entries however many
pieces there are: the longest length left opens a sequence; if the rest can be filled exactly by one,
two or three lengths that are still available (looked up in indexes of the single, pair and triple
sums), that combination is used as often as counts allow; otherwise the best-fitting sum is taken.
Pieces then find their places by their rank among the pieces of their length.

Defined cases: a null text is empty; every text ends with one end token, so none has length 0; an id
that occurs twice gives two sets of pieces; no rows give no pieces. Ranks come from (length, part)
counts, so a length that most pieces have is spread over many tasks.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from emberwatch.llm.arrow import chunks
from emberwatch.plans.lineage import pin

LIMIT, END = 4096, 1
#: Words that a worker process remembers.
ROOM = 600_000
#: Pieces that one part of a length holds on average when places are given out.
PART_ROWS = 100_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

#: Marks that may end a word; without letters behind it none of them starts a pattern of its own.
PUNCTUATION = string.punctuation

#: Letters from here on may be composed, folded or classed in ways of their own; those before are lower-cased one by one.
LATIN = "\u0250"
#: The letters that stand for the bytes of UTF-8 in the tokenizer's model.
BYTES = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

_TOKENIZER: dict = {}


class Tokens:
    """Token ids of texts as little-endian bytes, with a memory of words seen before.

    The tokenizer splits at white space and drops it, splits letters from other characters and folds
    case, so the ids of a text are those of its space-separated chunks in a row, and those of a word with
    trailing punctuation are the word's and the punctuation's. A lower-case word of Latin letters is one
    input of the tokenizer's model, byte by byte. The memory is per worker process and emptied when it is full.
    """

    def __init__(self, path: str, room: int = ROOM):
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}

    def _apart(self, chunks_: list[str]) -> None:
        for chunk, got in zip(chunks_, self.tokenizer.encode_batch_fast(chunks_, add_special_tokens=False)):
            self.known[chunk] = np.asarray(got.ids, "<u4").tobytes()

    def _words(self, words: list[str]) -> None:
        """Words of letters only, as one text whose ids are then split by word."""
        got = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        owner = np.asarray(got.word_ids, np.int64)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        if len(first) != len(words):  # folding has split a word
            return self._apart(words)
        ids, ends = np.asarray(got.ids, "<u4").tobytes(), (4 * np.append(first[1:], len(owner))).tolist()
        start = 0
        for word, end in zip(words, ends):
            self.known[word] = ids[start:end]
            start = end

    def _latin(self, words: set[str]) -> None:
        """Lower-case words of letters below ``LATIN``, by the model itself."""
        known, ids_of = self.known, self.model.tokenize
        for word in words:
            ids = [t.id for t in ids_of(word if word.isascii() else word.encode().decode("latin-1").translate(BYTES))]
            known[word] = struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, new: set[str]) -> None:
        known, latin, words, apart, joined = self.known, set(), set(), [], []
        for chunk in new:
            word = chunk.rstrip(PUNCTUATION)
            if not word.isalpha():
                apart.append(chunk)
                continue
            tail = chunk[len(word) :]
            low = word.lower()
            if low.isascii() or max(low) < LATIN:
                word = low
                if word not in known:
                    latin.add(word)
            elif word not in known:
                words.add(word)
            if tail not in known:
                self._apart([tail])
            if word != chunk:
                joined.append((chunk, word, tail))
        self._latin(latin)
        words_ = list(words)
        for i in range(0, len(words_), 2_000):
            self._words(words_[i : i + 2_000])
        for i in range(0, len(apart), 2_000):
            self._apart(apart[i : i + 2_000])
        for chunk, word, tail in joined:
            known[chunk] = known[word] + known[tail]

    def forget(self) -> None:
        self.known.clear()
        self.known[""] = b""

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.known
        new = set().union(*split).difference(known)
        if len(known) + 2 * len(new) > self.room:
            self.forget()
            new = set().union(*split).difference(known)
        self.learn(new)
        return [b"".join(map(known.__getitem__, s)) for s in split]


def tokens(path: str) -> Tokens:
    if path not in _TOKENIZER:
        _TOKENIZER[path] = Tokens(path)
    return _TOKENIZER[path]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, doc_id: str = "doc_id", text: str = "text", room: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; ``tokenizer`` is a path on the workers.

    With ``room`` a task remembers that many words and forgets them at its end, so that idle workers hold no memory
    that other steps of a job need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tail = tokens(tokenizer), np.asarray([end], "<u4").tobytes()
        coder.room = room or ROOM
        for batch in chunks(batches, "text", 1 << 20):
            rows = []
            for did, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").fill_null("").to_pylist())):
                ids += tail
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((did, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if room:
            coder.forget()

    return docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text").mapInArrow(run, PIECES)


class _Lengths:
    """How many pieces of every length are left, with lookups of exact complements."""

    def __init__(self, histogram: dict[int, int], limit: int):
        self.left = np.zeros(limit + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.changed()

    def changed(self) -> None:
        self.some = self.left > 0
        self.lengths = np.flatnonzero(self.some)

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.changed()

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.some[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths that sum to the gap, the larger one as large as possible."""
        half = -(-gap // 2)
        large = np.arange(gap - 1, half - 1, -1)
        fits = self.some[large] & self.some[gap - large]
        if gap % 2 == 0 and len(fits) and self.left[half] < 2:
            fits[-1] = False
        return (int(large[at]), gap - int(large[at])) if len(fits) and fits[at := int(fits.argmax())] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        """Three lengths that sum to the gap: each length and the pairs that complete it."""
        for x in self.lengths[(self.lengths < gap - 1) & (3 * self.lengths >= gap)][::-1].tolist():
            two = self.pair(gap - x)
            if two and self.left[x] > two.count(x):
                return (x, *two)
        return None

    def fill(self, gap: int) -> tuple[int, ...]:
        """An exact combination for the gap, else the best fit: the largest sum of one or two below it."""
        exact = self.single(gap) or self.pair(gap) or self.triple(gap)
        if exact:
            return exact
        fit = self.lengths[self.lengths < gap]
        if not len(fit):
            return ()
        other = np.searchsorted(fit, gap - fit, side="right") - 1
        sums = np.where(other >= 0, fit + fit[other], 0)
        at = int(sums.argmax())
        a, b = int(fit[at]), int(fit[other[at]])
        return (a, b) if sums[at] > fit[-1] and (a != b or self.left[a] > 1) else (int(fit[-1]),)


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using up the histogram.

    Every entry uses up a length or all but a few pieces of it, so there are about as many entries as lengths.
    """
    pool, out = _Lengths(histogram, limit), []
    while len(pool.lengths):
        parts = [int(pool.lengths[-1])]
        pool.take(parts[0])
        while (gap := limit - sum(parts)) > 0 and len(pool.lengths):
            more = pool.fill(gap)
            if not more:
                break
            parts += more
            for x in more:
                pool.take(x)
        times = 1 + min(int(pool.left[x]) // parts.count(x) for x in set(parts))
        for x in parts if times > 1 else ():
            pool.take(x, times - 1)
        out.append((tuple(parts), times))
    return out


def places(plan_: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """Per length rows (first rank, first sequence, offset), ranks ascending: where its pieces go."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for parts, times in plan_:
        offset = 0
        for x in parts:
            rows.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.asarray(r, np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end: int = END, doc_id: str = "doc_id", text: str = "text", room: int | None = None) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset`` (both long)."""
    cut = pin(pieces(docs, tokenizer, limit, end, doc_id, text, room))
    total = cut.count()
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(max(1, -(-total // PART_ROWS))))
    parted = cut.withColumn("part", part)
    counts = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``limit`` rows
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, limit)))
    # one row per part of a length
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    first = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("first"))
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = parted.withColumn("own", own).join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("own") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                at, t = np.flatnonzero(length == x), table[int(x)]
                row = np.searchsorted(t[:, 0], rank[at], side="right") - 1
                seq[at], off[at] = t[row, 1] + rank[at] - t[row, 0], t[row, 2]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(off)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PIECES + ", sequence_id bigint, offset bigint")
