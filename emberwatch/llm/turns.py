"""Conversation structure repair: the cheapest edits that make the roles of a conversation ``(s?(ua)+)?``.

Every row becomes one symbol, made of the first letter of its role and its first fault. A four-state automaton
(nothing yet, after s, after u, after a) reads the repaired roles; what one symbol can do to the state, with
any inserts before it, is a min-plus matrix whose entries hold the cost and the audit, the edits' letters.
Of equally cheap audits the least in ASCII order counts. Two different audits of one entry and equal cost are
never prefixes of each other (what follows would be inserts, which cost), so products of matrices keep both
the cost and the order, and pieces can be evaluated apart.

Symbol sequences repeat across conversations, so they are compressed by Re-Pair: in rounds, the most frequent
pairs of neighbouring symbols over all distinct sequences become new symbols. Each rule has one matrix, the
product of those of its two symbols, computed once, bottom-up, and shared by all conversations. A rule keeps
the state between its halves for each entry; its audit is a rope, put together from the halves' on demand.

Rows are never gathered by conversation before they are one byte each: narrow rows are sorted by range, so a
long conversation is spread over tasks, which emit stretches of symbols that are joined in order. Duplicates
come from a grouped minimum. Only the digest, which hashes a whole conversation in order, reads it in one
task, as a sorted stream in constant memory.

Defined cases: null roles and texts are one space, a null id or turn is one space in the checksum; a null id
is a conversation of its own; null turns come first; rows of one turn stand in the order of the MD5 of role
and text; repeated rows are duplicates; an empty table gives no row. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.llm.arrow import ints
from emberwatch.plans.lineage import pin

#: Bounds of the grammar: rounds, rules, rows that a rule stands for. They bound what tasks are sent (a rule has
#: 16 entries of at most 3 * MAX_SPAN letters); symbols beyond are evaluated one by one, with the same result.
MAX_ROUNDS, MAX_RULES, MAX_SPAN = 12, 512, 512
#: Least uses of a pair to make it a rule.
MIN_USES = 2
_BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Faults of a row, by the first that holds.
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
#: Classes of a role's first letter.
S, U, A, OTHER = range(4)
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS = 2, 3, 2, 1
#: The state after a user or assistant row is put in: user unless the row before is a user's.
_NEXT = (2, 2, 3, 2)
_STATES = range(4)

Entry = tuple[int, str]


def damage(conversations: DataFrame) -> DataFrame:
    """Columns conv_id, turn, role, text and ``copies`` (0 where the row is dropped) of deliberately broken rows."""
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named.cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def whole(conversations: DataFrame) -> DataFrame:
    """The rows as they are, each once."""
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _key(rows: DataFrame) -> str:
    return f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"


def _content() -> Column:
    return F.unhex(F.md5(F.concat_ws(":", F.char_length("role").cast("string"), "role", "text").cast("binary")))


# -- symbols -------------------------------------------------------------------------------------------------

def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, symbols binary, gaps): one byte a row, 4 * class of the role + fault, for every conv_id of ``rows``."""
    inked = F.rtrim("text", F.lit(_BLANK_CHARS))
    fault = F.when(inked == "", BLANK).when(~F.right(inked, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER)
    narrow = rows.select("conv_id", "turn", _content().alias("content"), (4 * kind + fault).alias("symbol"), "copies")
    each = narrow.groupBy("conv_id", "turn", "content").agg(F.max("symbol").alias("symbol"), F.sum("copies").alias("n"))
    first = each.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("content").alias("h")).agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced"))
    marked = each.join(first, each["conv_id"].eqNullSafe(first["c"]) & (each["content"] == first["h"]), "left").select(
        "conv_id", "turn", "content", "symbol", "n", F.coalesce(F.when(F.col("unplaced"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least")), F.lit(False)).alias("first"))
    ordered = marked.repartitionByRange("conv_id", "turn", "content").sortWithinPartitions("conv_id", "turn", "content")
    key = _key(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_key, pieces, seen = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("conv_id")
            code = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
            cuts = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])
            symbol, n = ints(batch, "symbol").astype(np.uint8), ints(batch, "n").astype(np.int64)
            turn, known = batch.column("turn").fill_null(0).to_numpy(zero_copy_only=False), np.asarray(batch.column("turn").is_valid()) & (n > 0)
            again = np.where(symbol & 3 == BLANK, symbol, symbol & 12 | DUPLICATE)
            ends = np.concatenate([[0], np.cumsum(n)])
            rows_out = np.repeat(again, n)
            lead = np.asarray(batch.column("first")) & (n > 0)
            rows_out[ends[:-1][lead]] = symbol[lead]
            for i in range(len(cuts) - 1):
                lo, hi = cuts[i], cuts[i + 1]
                name = keys[lo]
                if pieces is None or name != open_key:
                    if pieces is not None:
                        yield _stretch(open_key, part, pieces, seen)
                    open_key, pieces, seen = name, [], [0, None, None]
                pieces.append(rows_out[ends[lo] : ends[hi]].tobytes())
                placed = turn[lo:hi][known[lo:hi]]
                if len(placed):
                    seen[0] += 1 + int((placed[1:] != placed[:-1]).sum()) - (seen[2] == placed[0])
                    seen[1] = int(placed[0]) if seen[1] is None else seen[1]
                    seen[2] = int(placed[-1])
        if pieces is not None:
            yield _stretch(open_key, part, pieces, seen)

    cut = ordered.mapInArrow(run, f"{key}, part int, symbols binary, turns bigint, low bigint, high bigint")
    told = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "symbols", "turns", "low", "high"))).alias("s"))
    # a turn cut in two by the range is counted in both stretches
    placed = F.filter("s", lambda x: x["low"].isNotNull())
    shared = F.aggregate(placed, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("last")), lambda a, x: F.struct(
        (a["n"] + F.when(a["last"] == x["low"], 1).otherwise(0)).alias("n"), x["high"].alias("last")))["n"]
    turns = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["turns"]) - shared
    return told.select(
        "conv_id", F.when(F.size("s") == 1, F.col("s")[0]["symbols"]).otherwise(F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["symbols"])), ""))).alias("symbols"),
        F.coalesce(F.array_max(placed["high"]) - F.array_min(placed["low"]) + 1 - turns, F.lit(0)).alias("gaps"))


def _stretch(key: pa.Scalar, part: int, pieces: list[bytes], seen: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key.as_py()], key.type), pa.array([part], pa.int32()), pa.array([b"".join(pieces)], pa.binary()), *(pa.array([x], pa.int64()) for x in seen)],
        ["conv_id", "part", "symbols", "turns", "low", "high"])


# -- matrices ------------------------------------------------------------------------------------------------

def _inserts(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, audit) after no, one or two inserts; more would only come back to the same states."""
    one = _NEXT[state]
    return [(state, 0, ""), (one, INSERT, "I"), (_NEXT[one], 2 * INSERT, "II")]


def _edits(symbol: int, state: int) -> list[tuple[int, int, str]]:
    kind, fault = symbol >> 2, symbol & 3
    out = [(state, DELETE, "D")]
    if fault in (FINE, TRUNCATED):
        stays = STAYS * (fault == TRUNCATED)
        out.append((_NEXT[state], REROLE + stays, "R"))
        if (kind == S and state == 0) or (kind in (U, A) and _NEXT[state] == kind + 1):
            out.append((kind + 1, stays, "K"))
    return out


def _symbol_matrix(symbol: int) -> list[list[Entry | None]]:
    out: list[list[Entry | None]] = [[None] * 4 for _ in _STATES]
    for p in _STATES:
        for mid, c, text in _inserts(p):
            for q, c2, letter in _edits(symbol, mid):
                best = (c + c2, text + letter)
                if out[p][q] is None or best < out[p][q]:
                    out[p][q] = best
    return out


def _last_matrix() -> list[list[Entry | None]]:
    out: list[list[Entry | None]] = [[None] * 4 for _ in _STATES]
    for p in _STATES:
        for q, c, text in _inserts(p):
            if out[p][q] is None or (c, text) < out[p][q]:
                out[p][q] = (c, text)
    return out


class Grammar:
    """Rules in rounds, and the matrix of every symbol."""

    def __init__(self) -> None:
        self.rounds: list[list[tuple[int, int, int]]] = []  # (left, right, new symbol) of each round
        self.costs: dict[int, list[list[int | None]]] = {}
        self.mids: dict[int, list[list[int]]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.span: dict[int, int] = {}
        self._ropes: dict[tuple[int, int, int], str] = {}
        for symbol in {canonical(x) for x in range(16)}:
            matrix = _symbol_matrix(symbol)
            self.costs[symbol] = [[e and e[0] for e in row] for row in matrix]
            self._ropes.update({(symbol, p, q): matrix[p][q][1] for p in _STATES for q in _STATES if matrix[p][q]})
            self.span[symbol] = 1

    @property
    def rules(self) -> int:
        return len(self.halves)

    def rope(self, symbol: int, p: int, q: int) -> str:
        key = symbol, p, q
        if key not in self._ropes:
            (left, right), mid = self.halves[symbol], self.mids[symbol][p][q]
            self._ropes[key] = self.rope(left, p, mid) + self.rope(right, mid, q)
        return self._ropes[key]

    def add(self, pairs: list[tuple[int, int]]) -> None:
        """One round of rules, with their matrices as products of earlier ones."""
        done = []
        for left, right in pairs:
            new = 16 + self.rules
            costs: list[list[int | None]] = [[None] * 4 for _ in _STATES]
            mids = [[0] * 4 for _ in _STATES]
            for p in _STATES:
                for q in _STATES:
                    ways = [(a + b, m) for m in _STATES if (a := self.costs[left][p][m]) is not None and (b := self.costs[right][m][q]) is not None]
                    if not ways:
                        continue
                    least = min(ways)[0]
                    tied = [m for c, m in ways if c == least]
                    costs[p][q] = least
                    mids[p][q] = tied[0] if len(tied) == 1 else min(tied, key=lambda m: self.rope(left, p, m) + self.rope(right, m, q))
            self.costs[new], self.mids[new], self.halves[new], self.span[new] = costs, mids, (left, right), self.span[left] + self.span[right]
            done.append((left, right, new))
        self.rounds.append(done)

    def compress(self, flat: np.ndarray) -> np.ndarray:
        """Sequences, each ended by -1, with the rules applied round by round."""
        for rules in self.rounds:
            if len(flat) < 2:
                break
            size = int(max(flat.max(), max(max(r) for r in rules))) + 2
            codes = np.array([(a + 1) * size + b + 1 for a, b, _ in rules])
            order = np.argsort(codes)
            pair = (flat[:-1] + 1) * size + flat[1:] + 1
            at = np.minimum(np.searchsorted(codes[order], pair), len(codes) - 1)
            hit = codes[order][at] == pair
            same = hit & (flat[:-1] == flat[1:])
            if same.any():  # in a run of one symbol every second pair, from the left
                place = np.arange(len(hit))
                start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], same[:-1] & hit[:-1]]), place, -1))
                hit &= ~same | ((place - start) % 2 == 0)
            flat = flat.copy()
            where = np.flatnonzero(hit)
            flat[where] = np.array([r[2] for r in rules])[order][at[where]]
            keep = np.ones(len(flat), bool)
            keep[where + 1] = False
            flat = flat[keep]
        return flat

    def best(self, symbols: list[int]) -> Entry:
        """The cheapest audit of a compressed sequence."""
        if len(symbols) <= 256:
            vector: list[Entry | None] = [(0, ""), None, None, None]
            for symbol in symbols:
                vector = self._step(vector, symbol)
        else:  # blocks as matrices, then pairs of neighbours, so that no letter is copied often
            blocks = []
            for i in range(0, len(symbols), 256):
                matrix: list[list[Entry | None]] = [[(0, "") if p == q else None for q in _STATES] for p in _STATES]
                for symbol in symbols[i : i + 256]:
                    matrix = [self._step(row, symbol) for row in matrix]
                blocks.append(matrix)
            while len(blocks) > 1:
                blocks = [_product(blocks[i], blocks[i + 1]) if i + 1 < len(blocks) else blocks[i] for i in range(0, len(blocks), 2)]
            vector = blocks[0][0]
        ends = _product([vector], _last_matrix())[0]
        return min(e for e in (ends[0], ends[3]) if e is not None)

    def _step(self, vector: list[Entry | None], symbol: int) -> list[Entry | None]:
        costs = self.costs[symbol]
        out: list[Entry | None] = [None] * 4
        for q in _STATES:
            ways = [(vector[p][0] + costs[p][q], p) for p in _STATES if vector[p] is not None and costs[p][q] is not None]
            if ways:
                least = min(ways)[0]
                out[q] = least, min(vector[p][1] + self.rope(symbol, p, q) for c, p in ways if c == least)
        return out


def _product(x: list[list[Entry | None]], y: list[list[Entry | None]]) -> list[list[Entry | None]]:
    out = []
    for row in x:
        line: list[Entry | None] = []
        for q in _STATES:
            ways = [(row[m][0] + y[m][q][0], m) for m in _STATES if row[m] is not None and y[m][q] is not None]
            least = min(ways)[0] if ways else 0
            line.append((least, min(row[m][1] + y[m][q][1] for c, m in ways if c == least)) if ways else None)
        out.append(line)
    return out


def canonical(symbol: int) -> int:
    """Symbols with the same edits as one: a row that must go has no role that matters."""
    return BLANK if symbol & 3 >= DUPLICATE else symbol


_CANONICAL = np.array([canonical(x) for x in range(16)], np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, each row ended by -1, and the raw lengths."""
    raw = [np.frombuffer(x, np.uint8) for x in column.to_pylist()]
    lengths = np.array([len(x) for x in raw], np.int64)
    flat = np.full(int(lengths.sum()) + len(raw), -1, np.int64)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    if len(raw):
        flat[inside] = _CANONICAL[np.concatenate(raw)]
    return flat, lengths


def learn(sequences_: DataFrame, max_rounds: int = MAX_ROUNDS, max_rules: int = MAX_RULES, max_span: int = MAX_SPAN) -> Grammar:
    """The grammar of all distinct ``symbols``. Tasks count pairs; what reaches the driver is the most frequent ones of a round."""
    grammar = Grammar()
    texts = pin(sequences_.select("symbols").distinct())
    for _ in range(max_rounds):

        def count(batches: Iterator[pa.RecordBatch], grammar: Grammar = grammar) -> Iterator[pa.RecordBatch]:
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for batch in batches:
                flat = grammar.compress(_flat(batch.column("symbols"))[0])
                pair = flat[:-1] << 32 | flat[1:]
                k, n = np.unique(pair[(flat[:-1] >= 0) & (flat[1:] >= 0)], return_counts=True)
                keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

        room = max_rules - grammar.rules
        if room <= 0:
            break
        top = texts.mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_USES).orderBy(F.desc("n"), "pair").limit(4 * room)
        lefts, rights, chosen = set(), set(), []
        for r in top.collect():
            a, b = r.pair >> 32, r.pair & 0xFFFFFFFF
            # pairs of one round must not overlap anywhere, so that their order does not matter
            if a not in rights and b not in lefts and (a != b or (a not in lefts and b not in rights)) and grammar.span[a] + grammar.span[b] <= max_span:
                lefts.add(a)
                rights.add(b)
                chosen.append((a, b))
                if len(chosen) == room:
                    break
        if not chosen:
            break
        grammar.add(chosen)
    return grammar


def audits(sequences_: DataFrame, grammar: Grammar) -> DataFrame:
    """Per row of ``sequences_``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    key = _key(sequences_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, Entry] = {}
        for full in batches:
            for start in range(0, full.num_rows, 2048):
                batch = full.slice(start, 2048)
                column = batch.column("symbols")
                flat, lengths = _flat(column)
                raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
                row = np.repeat(np.arange(len(lengths)), lengths)
                faults = [np.bincount(row[raw & 3 == f], minlength=len(lengths)) for f in (BLANK, DUPLICATE, TRUNCATED)]
                pair = (raw[:-1] >> 2) * 4 + (raw[1:] >> 2)
                wrong = ~np.isin(pair, [S * 4 + U, U * 4 + A, A * 4 + U]) & (row[:-1] == row[1:])
                illegal = np.bincount(row[:-1][wrong], minlength=len(lengths))
                short = grammar.compress(flat)
                ends = np.flatnonzero(short < 0)
                found = []
                for lo, hi in zip(np.concatenate([[0], ends[:-1] + 1]), ends):
                    name = short[lo:hi].tobytes()
                    if name not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[name] = grammar.best(short[lo:hi].tolist())
                    found.append(known[name])
                numbers = [pa.array(x.astype(np.int64)) for x in (*faults, illegal)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("conv_id"), batch.column("gaps"), *numbers, pa.array([c for c, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())],
                    ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return sequences_.mapInArrow(run, f"{key}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


# -- the repaired rows ---------------------------------------------------------------------------------------

_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plan(rows: DataFrame) -> DataFrame:
    """The audit of every conversation of ``rows`` (see ``damage`` and ``whole``), with its counts."""
    told = pin(sequences(rows))
    return audits(told, learn(told))


def _streams(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows in order behind their conversation's plan, so that tasks read them as streams."""
    heads = plans.select("conv_id", F.lit(0).alias("tag"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("binary").alias("content"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), *_COUNTS)
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("tag"), "turn", _content().alias("content"), "role", "text", "copies", *[F.lit(None).cast("bigint").alias(c) for c in _COUNTS])
    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "content").drop("turn", "content")


class _Mender:
    """Follows the audit of one conversation and tells each repaired row as it comes."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _put(self) -> str:
        self.state = _NEXT[self.state]
        return "user" if self.state == 2 else "assistant"

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            yield "I", self._put(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._put(), text


def _walk(batches: Iterator[pa.RecordBatch], begin: Callable, turn: Callable, end: Callable) -> Iterator:
    """Calls ``begin(head)``, ``turn(edit, role, text)`` and ``end()`` along the streams; yields what they return."""
    mender = None
    for batch in batches:
        tags, roles, texts, copies = (batch.column(c).to_pylist() for c in ("tag", "role", "text", "copies"))
        for i, tag in enumerate(tags):
            if tag == 0:
                if mender is not None:
                    for put in mender.inserts():
                        yield turn(*put)
                    yield end()
                mender = _Mender(texts[i])
                begin(batch, i)
                continue
            for _ in range(copies[i]):
                for put in mender.row(roles[i], texts[i]):
                    yield turn(*put)
    if mender is not None:
        for put in mender.inserts():
            yield turn(*put)
        yield end()


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role, text."""
    key = _key(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = {}

        def begin(batch: pa.RecordBatch, i: int) -> None:
            now.update(key=batch.column("conv_id")[i], place=-1)

        def turn(edit: str, role: str, text: str) -> tuple:
            now["place"] += 1
            return now["key"].as_py(), now["place"], edit, role, text

        held, size, kind = [], 0, None
        for told in _walk(batches, begin, turn, lambda: None):
            if told is None:
                continue
            kind = now["key"].type
            held.append(told)
            size += len(told[4]) + 100
            if size > 1 << 22:
                yield _rows(held, kind)
                held, size = [], 0
        if held:
            yield _rows(held, kind)

    return _streams(rows, plan(rows)).mapInArrow(run, f"{key}, place bigint, edit string, role string, text string")


def _rows(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*held), (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "edit", "role", "text"])


def digest(rows: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit, and the SHA-256 of the repaired rows as ``role:text`` lines."""
    key = _key(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}

        def begin(batch: pa.RecordBatch, i: int) -> None:
            now.update(head=batch.slice(i, 1), sha=hashlib.sha256(), first=True)

        def turn(edit: str, role: str, text: str) -> None:
            now["sha"].update((("" if now["first"] else "\n") + f"{role}:{text}").encode())
            now["first"] = False

        def end() -> pa.RecordBatch:
            head = now["head"]
            return pa.RecordBatch.from_arrays(
                [head.column("conv_id"), *(head.column(c) for c in _COUNTS), head.column("text"), pa.array([now["sha"].hexdigest()])],
                ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        held = []
        for told in _walk(batches, begin, turn, end):
            if told is not None:
                held.append(told)
            if len(held) == 1000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    numbers = ", ".join(f"{c} bigint" for c in _COUNTS)
    return _streams(rows, plan(rows)).mapInArrow(run, f"{key}, {numbers}, audit string, repaired_sha256 string")
