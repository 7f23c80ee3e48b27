"""Personal data, also behind disguises, with positions in the source text.

Plain patterns are looked for in the text as it is. A chain of transducers then normalises disguised
stretches (look-alike letters, full-width forms, invisible characters, digits, at and dot spelled in four
languages), each keeping for every character it writes the source stretch it came from; identifiers found
in the normalised text are mapped back to source positions and added where no plain match of any kind
overlaps them.

Defined cases: a null text is empty; positions are code points, end exclusive; kinds are looked for
independently, so a plain span may overlap one of another kind; a failing plain match is dropped and
not retried; an added span never overlaps a plain one; a disguise is only accepted if its normalised
form passes the same checks as a plain match. Repeated rows are treated each.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from emberwatch.llm.arrow import chunks

KINDS = ("email", "ip", "card", "phone")
FOUND = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string")

# The plain patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Letters of other scripts that look like Latin ones, in pairs.
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТУХаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονι",
    "ABEKMHOPCTYXaeopcyxijsdhqwABEZHIKMNOPTYXovi"))
INVISIBLE = "­​‌‍⁠﻿"
DASHES = "‐‑‒–—−"
SPACES = "    　"
# Names of the digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}
# How the signs of an address are spoken, at and dot of one language each.
SPOKEN = (("at", "dot"), ("ät|at|klammeraffe", "punkt"), ("arobase|arrobase", "point"), ("arroba", "punto"))

_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=lambda x: (-len(x), x))) + ")"
_AT, _DOT = ("|".join(sorted(set("|".join(x[i] for x in SPOKEN).split("|")))) for i in (0, 1))
#: Cheap test that a text may hold a disguise at all; a regular language, so one pass of an automaton.
#: Every first rewrite of ``normalise`` starts from a match: bare words only count where a bare "dot" stands between word characters.
TRIGGER = (
    "[" + "".join(LOOKALIKES) + INVISIBLE + DASHES + SPACES + "！-～٠-٩]"
    rf"|[\[({{<][ \t]*(?:{_AT}|@|{_DOT}|\.)[ \t]*[\])}}>]|[A-Za-z0-9_-][ \t]+(?:{_DOT})[ \t]+[A-Za-z0-9-]"
    r"|\b" + _DIGIT + r"[ \t,.-]+" + _DIGIT + r"[ \t,.-]+" + _DIGIT + r"\b")

#: Source stretch (start, end) of every character of a normalised text.
Tape = tuple[str, list[tuple[int, int]]]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each ``@``: its run of local characters starts the match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _numbers(kind: str, text: str) -> Iterator[tuple[int, int]]:
    for m in {"ip": IP, "card": CARD, "phone": PHONE}[kind].finditer(text):
        got = m.group()
        if kind == "ip":
            ok = all(int(p[-4:]) <= 255 and (len(p) < 4 or not p.strip("0") or len(p.lstrip("0")) <= 3) for p in got.split("."))
        elif kind == "card":
            digits = _digits(got)
            ok = 16 <= len(digits) <= 19 and luhn(digits)
        else:
            ok = 8 <= len(_digits(got)) <= 15
        if ok:
            yield m.span()


def plain(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    for kind in KINDS[1:]:
        out += [(kind, s, e) for s, e in _numbers(kind, text)]
    return out


def _characters(text: str) -> Tape:
    """Look-alikes, full-width forms, other digits, dashes and spaces to ASCII; invisible ones vanish."""
    out, at = [], []
    for i, c in enumerate(text):
        if c > "\x7f":
            if c in INVISIBLE:
                continue
            if c in LOOKALIKES:
                c = LOOKALIKES[c]
            elif "！" <= c <= "～":
                c = chr(ord(c) - 0xFEE0)
            elif "٠" <= c <= "٩":
                c = chr(ord(c) - 0x0660 + 48)
            elif c in DASHES:
                c = "-"
            elif c in SPACES:
                c = " "
        out.append(c)
        at.append((i, i + 1))
    return "".join(out), at


def _rewrite(tape: Tape, pattern: re.Pattern, to) -> Tape:
    """Replace every match by ``to(match)``; what it writes comes from the whole matched stretch."""
    text, at = tape
    out, places, last = [], [], 0
    for m in pattern.finditer(text):
        new = to(m)
        if new is None or m.end() == m.start():
            continue
        out += [text[last : m.start()], new]
        places += at[last : m.start()] + [(at[m.start()][0], at[m.end() - 1][1])] * len(new)
        last = m.end()
    return "".join(out) + text[last:], places + at[last:]


_SPELLED = re.compile(rf"\b{_DIGIT}(?:[ \t,.-]+{_DIGIT}){{2,}}\b", re.I)
_NAME = re.compile(_DIGIT, re.I)
# White space before a bracket counts from where it begins, so that a long run is read once.
_BEFORE = r"(?:(?<![ \t])[ \t]+)?"
_BRACKET_AT = re.compile(rf"{_BEFORE}[\[({{<][ \t]*(?:{_AT}|@)[ \t]*[\])}}>][ \t]*", re.I)
_BRACKET_DOT = re.compile(rf"{_BEFORE}[\[({{<][ \t]*(?:{_DOT}|\.)[ \t]*[\])}}>][ \t]*", re.I)
#: Labels of a host, and the local part of an address.
_LABEL, _LOCAL = "[A-Za-z0-9-]++", "[A-Za-z0-9._%+-]++"


def _spoken(at: str, dot: str) -> tuple[re.Pattern, ...]:
    """Patterns of one language: a bare dot, a bare at, a host behind ``@``, a local part before it, an address of numbers.

    Bare words only count as "name at host dot name", so that the words of a sentence are left alone: an at
    needs a dot in the host that follows, however long its labels are.
    """
    dot = rf"(?<![ \t])[ \t]+(?:{dot})[ \t]+"
    return tuple(re.compile(x, re.I) for x in (
        dot,
        rf"(?<=[A-Za-z0-9_-])[ \t]+(?:{at})[ \t]+(?={_LABEL}(?:\.{_LABEL})*+{dot}[A-Za-z0-9-])",
        rf"(?<=@){_LABEL}(?:(?:\.|{dot}){_LABEL})+",
        rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:{dot}{_LOCAL})++@?",
        rf"(?<![A-Za-z0-9])[0-9]++(?:{dot}[0-9]++){{3}}(?![A-Za-z0-9])"))


_LANGUAGES = tuple(_spoken(*x) for x in SPOKEN)


def _spelled(m: re.Match) -> str:
    return "".join(DIGITS[x.lower()] for x in _NAME.findall(m.group()))


def normalise(text: str) -> Tape:
    tape = _rewrite(_characters(text), _SPELLED, _spelled)
    tape = _rewrite(tape, _BRACKET_AT, lambda m: "@")
    tape = _rewrite(tape, _BRACKET_DOT, lambda m: ".")
    for dot, at, host, local, numbers in _LANGUAGES:
        if dot.search(tape[0]):
            dotted = lambda m: dot.sub(".", m.group())  # noqa: B023,E731
            tape = _rewrite(tape, at, lambda m: "@")
            tape = _rewrite(tape, host, dotted)
            tape = _rewrite(tape, local, lambda m: dotted(m) if m.group()[-1] == "@" else None)  # noqa: B023
            tape = _rewrite(tape, numbers, dotted)
    return tape


def disguised(text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the normalised text shows, in source positions; none overlaps ``known`` or another one."""
    norm, at = normalise(text)
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e in known):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for kind, s, e in plain(norm):
        start, end = at[s][0], at[e - 1][1]
        i = bisect.bisect_left(starts, end)  # stretches taken do not overlap, so only the last one before the end can reach in
        if norm[s:e] == text[start:end] or (i and ends[i - 1] > start):
            continue
        out.append((kind, start, end))
        starts.insert(i, start)
        ends.insert(i, end)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_pii(text: str, may_hide: bool = True) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, added spans) of one text."""
    base = plain(text)
    return base, disguised(text, base) if may_hide else []


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of plain spans by kind, ``n_added``, digest of the plain spans, and all spans."""
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 8 << 20):
            column = batch.column("text").fill_null("")
            plausible = pc.match_substring_regex(column, "[@0-9]").to_pylist()
            hidden = pc.match_substring_regex(column, TRIGGER, ignore_case=True).to_pylist()
            rows = []
            for i, did in enumerate(batch.column("doc_id").to_pylist()):
                base, more = ([], [])
                if plausible[i] or hidden[i]:
                    base, more = find_pii(column[i].as_py(), hidden[i])
                every = sorted(base + more, key=lambda x: (order[x[0]], x[1], x[2]))
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((did, *n, len(more), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols[:6]] + [pa.array(c, pa.string()) for c in cols[6:]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    return docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text").mapInArrow(run, FOUND)
