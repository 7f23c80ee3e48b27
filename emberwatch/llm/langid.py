"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts up to ``ORDER`` bytes deep is counted over all labelled texts.
A byte costs -log2 of its probability in the deepest context of the language's tree, or an escape and
its cost in the context one byte shorter, down to a uniform choice. Statistics are frozen after
counting, so the cost of every (context, byte) is a fixed number: a table, looked up for whole batches
of text at once. The language with the shortest code wins; ``score`` is its posterior among all and
"no language": the bytes of all labelled texts in any order, each at ``LOOSE_BITS`` more than its frequency says.
Text that costs that many more bits a byte as language than as loose bytes scores near 0, however much one language
is ahead of the others; rare words of a language stay far below.

The table has one row per context that occurs in the labelled texts; there are at most
A**ORDER of them for A distinct bytes (A <= 257), so its size is bounded whatever the input.

Defined cases: a null text and one without a letter are ``und`` with score 0; rows without a label
train nothing; without any labelled row all texts are ``und``; equal code lengths go to the language
that sorts first; texts are case-folded. Repeated rows count each in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.llm.arrow import chunks, utf8
from emberwatch.llm.names import fresh

#: Bytes of context.
ORDER = 3
#: Bits a text, and bits a byte, by which loose bytes must be cheaper than the best language to be as likely.
NO_LANGUAGE_BITS, LOOSE_BITS = 10, 0.5
UNKNOWN = "und"


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of the texts, each preceded by ORDER zero bytes, and where each text begins."""
    data, offsets = utf8(pc.utf8_lower(column))
    n = len(offsets) - 1
    out = np.zeros(len(data) + ORDER * n, np.uint8)
    place = np.arange(len(data)) + ORDER * (np.repeat(np.arange(n), np.diff(offsets)) + 1)
    out[place] = data
    return out, offsets + ORDER * np.arange(n + 1)


def counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, gram, n): how often each byte with its ORDER bytes before it occurs per language.

    A task sums up its own texts first, a piece at a time, so a language with most of the rows adds one
    row per gram and task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in chunks(batches, "text", 1 << 20):
            langs = np.asarray(batch.column("lang").to_pylist(), dtype=object)
            for name in sorted(set(langs)):
                mine = batch.column("text").filter(pa.array(langs == name))
                code, begins = _codes(mine)
                gram = np.zeros(max(0, len(code) - ORDER), np.uint32)
                for j in range(ORDER + 1):
                    gram = (gram << np.uint32(8)) | code[j : j + len(gram)]
                inside = np.ones(len(gram), bool)
                for j in range(ORDER):  # grams that would end in the zero bytes before the next text
                    at = begins[1:-1] - ORDER + j
                    inside[at] = False
                grams, n = np.unique(gram[inside], return_counts=True)
                if name in sums:
                    grams, at = np.unique(np.concatenate([sums[name][0], grams]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([sums[name][1], n]), len(grams)).astype(np.int64)
                sums[name] = grams, n
        for name, (grams, n) in sums.items():
            for i in range(0, len(grams), 50_000):
                g = grams[i : i + 50_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n[i : i + 50_000])], ["lang", "gram", "n"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and text != ''")
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen statistics: code lengths by (context, byte, language)."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        used = np.unique(np.concatenate([(gram >> (8 * j)) & 255 for j in range(ORDER + 1)])) if len(gram) else np.zeros(0, np.int64)
        a = self.size = len(used) + 1  # one more for every byte never seen
        self.code = np.full(256, a - 1, np.int64)
        self.code[used] = np.arange(len(used))
        symbol = self.code[gram & 255]
        # what a byte costs by its frequency alone
        self.loose = -np.log2(self._blend(np.bincount(symbol, n, a).reshape(1, a), np.full((1, a), 1.0 / 256)))[0] + LOOSE_BITS
        # contexts of the full depth, in the mixed base of the alphabet
        deep = np.zeros(len(gram), np.int64)
        for j in range(ORDER, 0, -1):
            deep = deep * a + self.code[(gram >> (8 * j)) & 255]
        contexts = np.unique(deep)
        costs = np.empty((len(contexts), a, len(langs)), np.float32)
        shallow = np.empty((a ** (ORDER - 1), a, len(langs)), np.float32)
        for k in range(len(langs)):
            mine = lang == k
            below = np.full((1, a), 1.0 / 256)
            for depth in range(ORDER):
                width = a**depth
                table = np.bincount((deep[mine] % width) * a + symbol[mine], n[mine], width * a).reshape(width, a)
                below = self._blend(table, below[np.arange(width) % len(below)])
            shallow[:, :, k] = -np.log2(below)
            table = np.bincount(np.searchsorted(contexts, deep[mine]) * a + symbol[mine], n[mine], len(contexts) * a).reshape(len(contexts), a)
            costs[:, :, k] = -np.log2(self._blend(table, below[contexts % len(below)]))
        # one table: rows of full contexts, then rows of contexts one byte shorter for all others
        self.costs = np.concatenate([costs, shallow]).reshape(-1, max(1, len(langs)))
        self.row = (np.arange(a**ORDER) % a ** (ORDER - 1) + len(contexts)).astype(np.int32)
        self.row[contexts] = np.arange(len(contexts))

    @staticmethod
    def _blend(table: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Escape by the number of distinct bytes seen (method C); an unseen context costs nothing."""
        total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        whole = np.maximum(total + kinds, 1)
        return np.where(total > 0, np.where(table > 0, table / whole, kinds / whole * below), below)

    def bits(self, column: pa.Array) -> np.ndarray:
        """(texts, languages and one more): exact code lengths in bits, the last one without any context."""
        out = np.zeros((len(column), len(self.langs) + 1))
        code, begins = _codes(column)
        if not len(code):
            return out
        ids = self.code[code]
        context = np.zeros(len(ids) - ORDER, np.int64)
        for j in range(ORDER):
            context = context * self.size + ids[j : j + len(context)]
        cost = self.costs[self.row[context].astype(np.int64) * self.size + ids[ORDER:]]
        sums = np.zeros((len(cost) + 1, len(self.langs) + 1))
        np.cumsum(cost, axis=0, dtype=np.float64, out=sums[1:, :-1])
        np.cumsum(self.loose[ids[ORDER:]], out=sums[1:, -1])
        # a text's own bytes are at begins + ORDER, whose costs stand at begins
        return sums[begins[1:] - ORDER] - sums[begins[:-1]]


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts are made by all tasks; what comes to the driver is the bounded table of grams."""
    got = counts(docs, lang, text).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(names)}
    lang_ids = np.array([index[x] for x in got.column("lang").to_pylist()], np.int64)
    return Model(names, lang_ids, got.column("gram").to_numpy(), got.column("n").to_numpy().astype(np.float64))


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` with the predicted language and its score, under ``names``, for every row."""
    given = text if text in keep else fresh(docs, "_text")[0]
    sent = [*keep] if text in keep else [*keep, F.col(text).alias(given)]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in chunks(batches, given, 1 << 19):
            column = batch.column(given).fill_null("")
            letters = np.asarray(pc.match_substring_regex(column, r"\p{L}"))
            langs, scores = np.full(len(column), UNKNOWN, dtype=object), np.zeros(len(column))
            if m.langs:
                bits = m.bits(column)
                bits[:, -1] += NO_LANGUAGE_BITS
                best = bits[:, :-1].argmin(1)
                share = 1 / np.exp2(np.clip(bits[np.arange(len(bits)), best][:, None] - bits, -1000, 1000)).sum(1)
                langs[letters] = np.asarray(m.langs, dtype=object)[best[letters]]
                scores[letters] = share[letters]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(langs.tolist(), pa.string()), pa.array(scores)],
                [f.name for f in kept] + list(names))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{names[0]}` string, `{names[1]}` double"
    return docs.select(*sent).mapInArrow(run, schema)


def identify(docs: DataFrame, trains: Column, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Learn from the labelled rows that ``trains`` selects, then predict every row."""
    return predict(docs, train(docs.where(trains), lang, text), text, keep, names)
