"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, units after numbers and names (capitalised words inside a sentence)
turn into typed placeholders, other words are lower-cased. A capitalised word at the start of a sentence may
be a name or not, unless it is one of OPENERS: it is read both ways. Windows of template words are joined by
hash, all windows of the benchmark with all of the documents, so any shared run of WINDOW words is met; an
item shorter than a window has one window of its own length. A window with fewer than ``MIN_LITERAL`` ordinary
words says little as a template: it is looked up with its words and values as they are written. Each document and item that meet are then
aligned word by word along the met diagonals, and the placeholders' values are checked: within one alignment
a benchmark value must always stand for the same document value and the other way round. A leak is an item of
which at least ``share`` of the words (and at least WINDOW, or all of a shorter item) align that way; ``kind``
is ``verbatim`` if all values agree, else ``reparameterised``.

Defined cases: null and empty texts have no template; an item of fewer than ``MIN_WORDS`` words, of any kind,
is no evidence and never reported; items with the same text are reported each; repeated
documents are reported once per id; a whole text of capitals has no names. Built from
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.plans.lineage import pin

#: Words of a window, ordinary words from which on a window is looked up as a template, least words of an item, share of an item.
WINDOW, MIN_LITERAL, MIN_WORDS, SHARE = 6, 3, 3, 0.5

# Units that follow a number.
UNITS = ("km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|pounds?|oz|tons?|l|ml|litres?|liters?|gallons?|s|sec|seconds?|min|minutes?|"
         "h|hours?|days?|weeks?|months?|years?|usd|eur|dollars?|euros?|cents?|percent|mph|kmh|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|v")
# Words that start a sentence and are no names.
OPENERS = ("The|An?|If|In|On|At|It|Its|He|She|They|We|You|Your|His|Her|Their|Our|My|This|That|These|Those|There|Then|Each|Every|All|Some|What|When|Where|"
           "Which|Who|Why|How|For|From|To|With|After|Before|But|And|Or|So|As|By|Is|Are|Was|Were|Do|Does|Did|Can|Could|Will|Would|Given|Find|Let|Suppose|"
           "Der|Die|Das|Ein|Eine|Es|Er|Sie|Wir|Wenn|Was|Wie|Le|La|Les|Un|Une|Il|Elle|Si|El|Los|Las|Una")
# The patterns look for the capital or digit first: what is around it is only looked at there, not at every place of a text.
_NAME = r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;:] )\p{Lu}\p{Ll}+"
_FIRST = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}\x01'’-])(?!(?:{OPENERS})(?!\p{{L}}))\p{{Lu}}\p{{Ll}}+"
_VALUE = r"(\d[\d\x04]*)"
_MEASURE = rf"(?i)(?=\d)\b{_VALUE}\s?(%|(?:{UNITS})\b)"
_MONEY = rf"([$€£])\s?{_VALUE}"
_NUMBER = rf"(?=\d)(?<![\x02\x04\d\p{{L}}]){_VALUE}\b"
_SPLIT = r"[^\p{L}\p{N}%$€£\x01\x02\x03\x04\x05]+"
#: Marks in front of a slot's value: name, number, unit. The fourth stands for a separator inside a number, the fifth is in front of what may be a name.
NAME, NUMBER, UNIT, POINT, MAYBE = "\x01", "\x02", "\x03", "\x04", "\x05"
#: Words from here on bear no mark.
ORDINARY = "\x06"


def words(text: Column) -> Column:
    """Template words with their values: an ordinary word, or a type mark followed by the value."""
    clean = F.when(text.rlike(r"[\x01-\x05]"), F.translate(text, "\x01\x02\x03\x04\x05", "     ")).otherwise(text)
    names = F.regexp_replace(F.regexp_replace(clean, _NAME, NAME + "$0"), _FIRST, MAYBE + "$0")
    joined = F.regexp_replace(names, r"[.,](?<=\d[.,])(?=\d)", POINT)
    measures = F.regexp_replace(joined, _MEASURE, f" {NUMBER}$1 {UNIT}$2 ")
    money = F.regexp_replace(measures, _MONEY, f" {UNIT}$1 {NUMBER}$2 ")
    numbers = F.regexp_replace(money, _NUMBER, f" {NUMBER}$1 ")
    marked = F.when(clean.rlike(r"\d"), numbers).otherwise(names)
    # a lone sign is no word; with a mark in front it is the value of a unit
    # (most words lie between the signs, so that two comparisons tell)
    return F.filter(F.split(F.lower(marked), _SPLIT), lambda w: ((w > "%") & (w < "£")) | ((w != "") & ~w.isin("%", "$", "€", "£")))


def _maybe(w: Column) -> Column:
    return F.substring(w, 1, 1) == MAYBE


def _template_word(w: Column, names: bool) -> Column:
    return F.when(w >= ORDINARY, w).when(w < POINT, F.substring(w, 1, 1)).when(_maybe(w), F.lit(NAME) if names else F.substring(w, 2, 1 << 20)).otherwise(w)


def _written_word(w: Column) -> Column:
    return F.when(w >= ORDINARY, w).when((w < POINT) | _maybe(w), F.substring(w, 2, 1 << 20)).otherwise(w)


def template(words_: Column, names: bool) -> Column:
    """The words with every value replaced by its placeholder's mark; what may be a name is one if ``names``."""
    return F.transform(words_, lambda w: _template_word(w, names))


def written(words_: Column) -> Column:
    """The words as they are written, without marks."""
    return F.transform(words_, _written_word)


def _poor(size: int) -> int:
    """Values and names from which on a window of ``size`` words is looked up as written."""
    return max(size - MIN_LITERAL + 1, 0)


def _readings(rows: DataFrame, key: str, literal: bool) -> DataFrame:
    """(key, ht, hl, maybe) of (key, w): word hashes of both readings, places of what may be a name.

    With ``literal`` also hw, the hashes of the words as written, and the places of values and names.
    These are columns of their own, as an expression inside a lambda would be computed for every window.
    """
    hashes = lambda of: F.transform("w", lambda w: F.xxhash64(of(w)))
    places = lambda of: F.filter(F.transform("w", lambda w, i: F.when((w < ORDINARY) & of(w), i)), lambda i: i.isNotNull())
    more = [hashes(_written_word).alias("hw"), places(lambda w: (w < POINT) | _maybe(w)).alias("slots")] if literal else []
    return rows.select(
        key, hashes(lambda w: _template_word(w, True)).alias("ht"), hashes(lambda w: _template_word(w, False)).alias("hl"), places(_maybe).alias("maybe"), *more)


def _hash(words_: str, i: Column, size: int, *more: Column) -> Column:
    """The hash of ``size`` elements from place ``i`` on, the same as that of an array of them."""
    return F.xxhash64(*[F.get(words_, i + j) for j in range(size)], *more)


def _windows(names: bool, size: int) -> Column:
    """Structs (h, at) of every window of ``size`` words in a reading; in the one without ``names`` only those that differ."""
    last = F.size("ht") - size
    if names:
        starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    else:
        near = F.array_distinct(F.flatten(F.transform("maybe", lambda i: F.sequence(F.greatest(i - (size - 1), F.lit(0)), i))))
        starts = F.filter(near, lambda i: i <= last)
    return F.transform(starts, lambda i: F.struct(_hash("ht" if names else "hl", i, size).alias("h"), i.alias("at")))


def _written_windows(size: int) -> Column:
    """Structs (h, at) of the windows of ``size`` words that hold too few ordinary ones for a template.

    They lie around ``need`` values in a row that are no further apart than a window, so in a text of
    ordinary words there is nothing to go through.
    """
    need, last = _poor(size), F.size("hw") - size
    # the k-th value and the one need - 1 further on; the window starts between the latter's reach and the former
    firsts = F.slice("slots", 1, F.greatest(F.size("slots") - (need - 1), F.lit(0)))
    ranges = F.transform(firsts, lambda i, k: F.struct(F.greatest(F.get("slots", k + (need - 1)) - (size - 1), F.lit(0)).alias("a"), F.least(i, last).alias("b")))
    close = F.filter(ranges, lambda x: x["a"] <= x["b"])
    starts = F.array_distinct(F.flatten(F.transform(close, lambda x: F.sequence(x["a"], x["b"]))))
    return F.transform(starts, lambda i: F.struct(_hash("hw", i, size, F.lit(1)).alias("h"), i.alias("at")))


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(h, item_id, item_at, size, literal) of all windows: in both readings those with enough ordinary words, others as written."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") >= MIN_WORDS)
    items = items.withColumn("size", F.least(F.size("w"), F.lit(WINDOW)))
    at = items.select("item_id", "size", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size"))).alias("item_at"))
    cut = at.withColumn("x", F.slice("w", F.col("item_at") + 1, F.col("size")))
    each = None
    for names in (True, False):
        part = cut.withColumn("t", template(F.col("x"), names)).where(F.size(F.filter("t", lambda w: w >= POINT)) >= MIN_LITERAL)
        part = part.select(F.xxhash64(F.transform("t", lambda w: F.xxhash64(w))).alias("h"), "item_id", "item_at", "size", F.lit(False).alias("literal"))
        each = part if each is None else each.unionByName(part)
    poor = cut.where(F.size(F.filter(template(F.col("x"), True), lambda w: w >= POINT)) < MIN_LITERAL)
    each = each.unionByName(poor.select(
        F.xxhash64(F.transform(written(F.col("x")), lambda w: F.xxhash64(w)), F.lit(1)).alias("h"), "item_id", "item_at", "size", F.lit(True).alias("literal")))
    return each.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_words, n_matched, n_slots, kind: one row per leaked item of a document."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Both small tables are written once, so that the planner knows their sizes before it chooses a join.
    index = pin(benchmark_windows(benchmark, item_id, item_text))
    # windows shorter than WINDOW, and those as written, are only looked up if an item has some
    kinds = sorted((r["size"], r["literal"]) for r in index.select("size", "literal").distinct().collect()) or [(WINDOW, False)]
    held = _readings(d.select("doc_id", words(F.col("text")).alias("w")), "doc_id", any(literal for _, literal in kinds))
    every = F.concat(*[x for size, literal in kinds for x in ([_written_windows(size)] if literal else [_windows(True, size), _windows(False, size)])])
    asked = held.select("doc_id", F.explode(every).alias("x")).select("doc_id", F.col("x.h").alias("h"), F.col("x.at").alias("at"))
    met = pin(asked.join(index, "h").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct())
    items = benchmark.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("iw")).where("size(iw) > 0")
    # A document is repeated per diagonal that met, so only the stretch beside the item travels on.
    texts = d.join(met.select("doc_id").distinct(), "doc_id").select("doc_id", words(F.col("text")).alias("dw"))
    lengths = items.select("item_id", F.size("iw").alias("n"))
    spans = met.join(lengths, "item_id")
    cut = texts.join(spans, "doc_id").select(
        "doc_id", "item_id", "shift", F.greatest(-F.col("shift"), F.lit(0)).alias("skip"),
        F.slice("dw", F.greatest(F.col("shift"), F.lit(0)) + 1, F.greatest(F.col("n") + F.least(F.col("shift"), F.lit(0)), F.lit(0))).alias("dw"))
    beside = cut.join(items, "item_id").withColumn("iw2", F.slice("iw", F.col("skip") + 1, F.greatest(F.size("dw"), F.lit(0))))
    pairs = F.zip_with("iw2", "dw", lambda i, w: F.struct(i.alias("i"), w.alias("d")))
    numbered = F.transform(pairs, lambda p, k: F.struct((k + F.col("skip")).alias("k"), p["i"].alias("i"), p["d"].alias("d")))
    # what may be a name is an ordinary word where both sides have the same, and a name where they differ
    name = lambda w: (F.substring(w, 1, 1) == NAME) | _maybe(w)
    value = lambda w: F.when(name(w), F.substring(w, 2, 1 << 20)).otherwise(w)
    equal = lambda p: (p["i"] == p["d"]) | ((_maybe(p["i"]) | _maybe(p["d"])) & (value(p["i"]) == value(p["d"])))
    slot = lambda p: ((p["i"] < POINT) & (F.substring(p["i"], 1, 1) == F.substring(p["d"], 1, 1))) | (
        name(p["i"]) & name(p["d"]) & ((value(p["i"]) != value(p["d"])) | (p["i"] < POINT) | (p["d"] < POINT)))
    same = F.filter(numbered, lambda p: equal(p) | slot(p))
    typed = lambda w: F.when(_maybe(w), F.concat(F.lit(NAME), value(w))).otherwise(w)
    aligned = beside.withColumn("same", same).withColumn("slots", F.array_distinct(F.transform(
        F.filter("same", slot), lambda p: F.struct(typed(p["i"]).alias("i"), typed(p["d"]).alias("d")))))
    one_to_one = (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))) & (
        F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["d"]))))
    # Slots of one diagonal that contradict each other do not count; the words around them still do.
    fair = aligned.select(
        "doc_id", "item_id", F.size("iw").alias("n"),
        F.transform(F.filter("same", lambda p: one_to_one | equal(p)), lambda p: p["k"]).alias("ks"),
        F.when(one_to_one, F.size("slots")).otherwise(0).alias("n_slots"),
        F.when(one_to_one, F.exists("slots", lambda s: s["i"] != s["d"])).otherwise(False).alias("changed"))
    # An item's own words bound what is gathered: at most one entry per word and diagonal
    whole = fair.where(F.size("ks") >= 1).select("doc_id", "item_id", "n", "n_slots", "changed", F.explode("ks").alias("k")).groupBy("doc_id", "item_id", "n").agg(
        F.countDistinct("k").alias("m"), F.max("n_slots").alias("n_slots"), F.max("changed").alias("changed"))
    enough = (F.col("m") >= F.lit(share) * F.col("n")) & (F.col("m") >= F.least(F.lit(WINDOW), F.col("n")))
    return whole.where(enough).select(
        "doc_id", "item_id", F.col("n").cast("bigint").alias("n_words"), F.col("m").alias("n_matched"), F.col("n_slots").cast("bigint").alias("n_slots"),
        F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no leaked item, with all their columns."""
    bad = pin(leaks(docs, benchmark, doc_id, text).select(F.col("doc_id").alias("bad")).distinct())
    return docs.join(bad, docs[doc_id] == bad["bad"], "left_anti")
