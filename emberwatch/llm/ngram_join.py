"""N-gram Jaccard self-join with token-combination prefixes.

A document's set holds its distinct ``k``-word shingles as 64-bit hashes. Documents with one set are one
node, so copies cost nothing. Two nodes link if 100 * intersection >= ``percent`` * union (80 or more). Candidates come from
two indexes, each used where it is sharp:

* Every set is ordered by hash. Its prefix is extended so far that linked sets share a number of
  tokens of their prefixes that grows with their size (``shared``). Tokens in at most ``RARE`` prefixes
  are indexed singly, and the nodes of such a token are paired directly (at most RARE - 1 partners a row).
* Linked sets that share no rare token share that many frequent ones. For the nodes that have so many,
  the prefix is extended to the whole set and dealt into classes, more of them than linked sets can
  differ in tokens; the tokens of a class are one combination. Linked sets have at least one
  combination in common, while sets that merely share a passage hardly ever do. Again, the nodes of a
  combination that at most RARE nodes have are paired directly.

The nodes of a frequent combination are compared with its hub, never with each other. The hub is the node
whose combinations most other nodes have, so the least edited one of a group of near copies, and the same
one for most of their combinations. Two nodes that are not both linked to the hub can only link if what
distinguishes them from the hub overlaps. These differences are joined by prefixes in turn, rare tokens
first, and only where one of the two is not yet in the hub's component. So a group of n near copies costs
n comparisons, not n * n / 2, and no pair is lost. Components then follow from the links.

Defined cases: A-Z are lower-cased, words are runs of bytes other than ASCII white space; a text with
fewer than k words is one shingle; without words, or null, it has no shingle and links with nothing;
nodes and tokens are told apart by 64-bit hashes. A repeated id is judged row by row, by the text of each.
A row without an id has the component of the documents of the same set, null if there are none; it links no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.llm.arrow import PIECE_BYTES, bounded, chunks, grams, ints, mix, signed, utf8, word_hashes
from emberwatch.llm.components import components
from emberwatch.plans.lineage import pin, release

#: Words of a shingle and least similarity of linked sets, unless others are asked for.
K, PERCENT = 4, 85
#: Below this, linked sets may share fewer tokens than ``shared`` asks for.
LEAST_PERCENT = 80
#: Prefixes a token, or nodes a combination, may be in to be indexed directly.
RARE = 16
#: Classes beyond the possible differences, and so the empty classes that a set may have.
SPARE = 2
#: Tokens that a round moves at least; shares of the tokens of all wanted sets that a round of pairs, or of differences, moves.
ROUND_TOKENS, PAIRS_SHARE, REST_SHARE = 8 << 20, 1, 8


def shared(n):
    """Tokens that the prefixes of linked sets share, the smaller one having ``n`` tokens (4 or more; smaller ones only link if equal)."""
    return 4 + (n - n % 50) / 50 if isinstance(n, Column) else 4 + n // 50


def max_difference(total: int, percent: int = PERCENT) -> int:
    """Largest symmetric difference of linked sets with ``total`` tokens together."""
    return (100 - percent) * total // (100 + percent)


def levels(top: int, percent: int = PERCENT) -> np.ndarray:
    """Lower bounds of size levels such that linked sets are in one level or two adjacent ones."""
    out = [1]
    while out[-1] <= top:
        out.append(out[-1] * 100 // percent + 1)
    return np.asarray(out + [out[-1] * 100 // percent + 1], np.int64)


def sets(batch: pa.RecordBatch, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens sorted by row and hash without repeats, row of each, tokens per row), worked out piece by piece."""
    parts, begin = [], 0
    for piece in chunks(iter([batch]), "text", PIECE_BYTES):
        token, trow, size = _sets(piece, k)
        parts.append((token, trow + begin, size))
        begin += piece.num_rows
    return tuple(map(np.concatenate, zip(*parts))) if parts else _sets(batch, k)


def _sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    hashes, row = word_hashes(data, offsets)
    n = batch.num_rows
    count = np.bincount(row, minlength=n)
    token, trow, _ = grams(hashes, row, k)
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        alone = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = count[short] > j
            alone[has] = mix(alone[has] * np.uint64(31) + hashes[first[short[has]] + j])
        alone = mix(alone + count[short].astype(np.uint64))
        token, trow = np.concatenate([token, alone]), np.concatenate([trow, short])
    order = np.lexsort((token, trow))
    token, trow = token[order], trow[order]
    if len(token):
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (trow[1:] != trow[:-1])])
        token, trow = token[new], trow[new]
    return token, trow, np.bincount(trow, minlength=n)


def _node(token: np.ndarray, trow: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit name of every row's set."""
    sums = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    ends = np.cumsum(size)
    return mix(sums[ends] - sums[ends - size] + size.astype(np.uint64))


def nodes(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, node, n) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            token, trow, size = sets(batch, k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed(_node(token, trow, size)), pa.array(size.astype(np.int64))], ["doc_id", "node", "n"])

    return docs.mapInArrow(run, "doc_id bigint, node bigint, n bigint")


def _need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of linked sets of ``n`` and ``m`` tokens."""
    return -(-percent * (n + m) // (100 + percent))


def prefixes(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(token, node, n, at): extended prefixes; kind 1 rows (token = node) say that a token is frequent already.

    A batch sends a token at most RARE + 1 times, which suffices to see that it is frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            token, trow, size = sets(batch, k)
            node = _node(token, trow, size)
            _, one = np.unique(node, return_index=True)
            keep = np.zeros(batch.num_rows, bool)
            keep[one] = True
            keep &= size > 0
            begin = np.cumsum(size) - size
            at = np.arange(len(token)) - begin[trow]
            length = np.minimum(size, size + (-percent * size // 100) + shared(size))  # n - ceil(n * percent / 100) + shared(n)
            use = keep[trow] & (at < length[trow])
            token, trow, at = token[use], trow[use], at[use]
            order = np.argsort(token, kind="stable")
            token, trow, at = token[order], trow[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
            runs = np.diff(np.append(first, len(token)))
            rank = np.arange(len(token)) - np.repeat(first, runs)
            often, sent = np.repeat(runs > RARE, runs), rank <= RARE
            rows = [(token, node[trow], size[trow], at, sent, 0), (node[trow], node[trow], size[trow], at, often & ~sent, 1)]
            for t, x, n, a, pick, kind in rows:
                if pick.any():
                    yield pa.RecordBatch.from_arrays(
                        [signed(t[pick]), signed(x[pick]), pa.array((n[pick] << 32 | a[pick] << 1 | kind).astype(np.int64))], ["token", "node", "place"])

    return docs.mapInArrow(run, "token bigint, node bigint, place bigint")


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs of nodes that share a rare token, and (a, null) for each frequent token of a node.

    ``rows`` come sorted by token; of a token that spans batches only RARE + 1 rows are carried on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def emit(token, node, place, last: bool):
            if not len(token):
                return held, []
            # copies of a set send equal rows; marks of one node differ in place
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1]) | (place[1:] != place[:-1])])
            token, node, place = token[new], node[new], place[new]
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            runs = np.diff(np.append(first, len(token)))
            size, at, marked = place >> 32, (place >> 1) & 0x7FFFFFFF, (place & 1).astype(bool)
            full = runs if last else runs[:-1]
            often = np.repeat(runs > RARE, runs) | marked
            out = [(node[often], None)]
            for d in range(1, RARE):  # partners d places apart in a rare token's run
                start = first[: len(full)][full > d]
                span = full[full > d]
                use = span <= RARE
                start, span = start[use], span[use]
                if not len(start):
                    break
                i = np.repeat(start - (np.cumsum(span - d) - (span - d)), span - d) + np.arange((span - d).sum())
                j = i + d
                need = _need(size[i], size[j], percent)
                ok = (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])) & (np.minimum(size[i] - at[i], size[j] - at[j]) + np.minimum(at[i], at[j]) >= need) & ~marked[i] & ~marked[j]
                out.append((np.minimum(node[i], node[j])[ok], np.maximum(node[i], node[j])[ok]))
            tail = slice(first[-1], min(len(token), first[-1] + RARE + 1))
            return ([np.zeros(0, np.int64)] * 3 if last else [token[tail], node[tail], place[tail]]), out

        def batch_of(out):
            for a, b in out:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [np.concatenate([h, ints(batch, c)]) for h, c in zip(held, ("token", "node", "place"))]
            held, out = emit(*columns, False)
            yield from batch_of(out)
        held, out = emit(*held, True)
        yield from batch_of(out)

    return rows.repartition("token").sortWithinPartitions("token", "node", "place").mapInArrow(run, "a bigint, b bigint")


def _token_sets(docs: DataFrame, k: int = K) -> DataFrame:
    """(node, n, tokens) of (doc_id, text, want) rows whose set has the name ``want``; from here on a node is named by its smallest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            token, trow, size = sets(batch, k)
            meant = pa.array(_node(token, trow, size).view(np.int64) == ints(batch, "want"))
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), signed(token))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size.astype(np.int64)), arrays], ["node", "n", "tokens"]).filter(meant)

    return docs.mapInArrow(run, "node bigint, n bigint, tokens array<bigint>")


def combinations_of(token: np.ndarray, bounds: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of one set: its classes of tokens under the schemes of its own size level and the one below.

    Under scheme l a set of level l or l + 1 is dealt into H + 1 + SPARE classes, H being the most that
    linked sets whose smaller one is of level l differ in. They agree in at least SPARE + 1 classes;
    one of them is not empty unless more than SPARE are, and sets with so many empty classes also get
    a key of their own.
    """
    n = len(token)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    keys = []
    for level in (own, own - 1):
        if level < 0:
            continue
        most = int(bounds[level + 1]) - 1
        differ = max_difference(most + most * 100 // percent, percent)
        if not differ:
            continue  # linked sets of these sizes are equal
        parts = differ + 1 + SPARE
        part = (mix(token ^ np.uint64(level + 1)) % np.uint64(parts)).astype(np.int64)
        sums, counts = np.zeros(parts, np.uint64), np.bincount(part, minlength=parts)
        np.add.at(sums, part, mix(token))
        name = mix(np.asarray([level + 1], np.uint64))[0]
        key = mix(mix(sums + counts.astype(np.uint64)) ^ mix(np.arange(parts, dtype=np.uint64) ^ name))
        keys.append(key[counts > 0])
        if (counts == 0).sum() > SPARE:
            keys.append(mix(np.asarray([name ^ np.uint64(0xABCDEF)], np.uint64)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _combinations(token_sets: DataFrame, percent: int) -> DataFrame:
    """(key, node) of (node, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            bounds = levels(int(np.diff(offs).max(initial=1)), percent)
            keys = [combinations_of(flat[offs[i] : offs[i + 1]], bounds, percent) for i in range(batch.num_rows)]
            if sum(map(len, keys)):
                yield pa.RecordBatch.from_arrays([signed(np.concatenate(keys)), pa.array(np.repeat(ints(batch, "node"), [len(k) for k in keys]))], ["key", "node"])

    return token_sets.select("node", "tokens").mapInArrow(run, "key bigint, node bigint")


def _linked(common, n, m, percent):
    return 100 * common >= percent * (n + m - common)


def _in_rounds(rows: DataFrame, key: str, rounds: int, step: Callable[[DataFrame, Callable[..., DataFrame]], DataFrame]) -> DataFrame:
    """``step`` of one part of the ``key``s after the other. It pins, so the disk holds the shuffles of one round at a time.

    ``step`` gets the rows of the round and a function that cuts another table down to its keys.
    """
    parts = []
    for i in range(rounds):
        own = lambda df, column=key, i=i: df if rounds == 1 else df.where(F.pmod(F.xxhash64(column), F.lit(rounds)) == i)
        parts.append(step(own(rows), own))
    return reduce(DataFrame.unionByName, parts)


def _rounds(tokens: int | None, held: int | None, share: int) -> int:
    """Rounds in which ``tokens`` move, ``held`` being those of all wanted sets."""
    return max(1, -(-(tokens or 0) // max(ROUND_TOKENS, (held or 0) // share)))


def _differences(pairs: DataFrame, token_sets: DataFrame, own_sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, linked, delta) of (a, b): delta is what tells b from a: first the ``fresh`` tokens that a lacks, then inverted those that b lacks. ``own_sets`` are the sets of every b."""
    left = token_sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = own_sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb) or hub")
    new, gone = F.array_except("tb", "ta"), F.array_except("ta", "tb")
    delta = F.concat(new, F.transform(gone, lambda t: F.bitwise_not(t)))
    out = both.select("a", "b", "na", "nb", "hub", F.size(new).alias("_new"), F.when(F.col("hub"), delta).alias("delta"))
    return out.withColumn("linked", _linked(F.col("nb") - F.col("_new"), F.col("na"), F.col("nb"), percent)).withColumn("fresh", F.col("_new")).drop("_new")


def _rest(members: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes that have a hub in common but are not yet in one component.

    Let x, y differ from hub h in d(x), d(y) tokens and link. If d(x) + d(y) is at most what linked sets
    of their sizes may differ in, then both link to h: n(y) <= n(h) + d(y), so with c = (100 - percent) / (100 + percent),
    d(x) <= c (n(x) + n(y)) - d(y) <= c (n(x) + n(h)). Otherwise their differences share at least half of
    the excess, and a prefix of them, rarest tokens first, must meet.

    One of the two is ``apart``, in another component than the hub. So only tokens that tell some node apart from the
    hub are looked at, and nodes of the hub's component are never joined with each other.
    """
    of = lambda x: comp.select(F.col("node").alias(x), F.col("component").alias(f"comp_{x}"))
    m = members.join(of("b"), "b", "left").join(of("a"), "a", "left").withColumn("comp", F.coalesce("comp_b", "b"))
    m = m.withColumn("apart", F.col("comp") != F.coalesce("comp_a", "a")).withColumn("d", F.size("delta")).where("d > 0")
    per, total = 100 - percent, 100 + percent
    # a partner of x has at least d(x) - H differences, and one of x and its partner does not link to the hub
    most = F.expr(f"floor({per} * (n + floor(n * 100 / {percent})) / {total})").cast("bigint")
    m = m.select("a", "b", F.col("nb").alias("n"), "comp", "apart", "d", "linked", "fresh", "delta").withColumn("most", most)
    # hubs that have a member apart, and their members that such a one may link to
    reach = m.where("apart").groupBy("a").agg(F.min(F.col("d") - F.col("most")).alias("_low"), F.max("d").alias("_high"))
    open_ = pin(m.join(reach, "a").where("apart or (d >= _low and d - most <= _high)").drop("_low", "_high"), release=True)
    each = open_.select("a", "b", "apart", "fresh", F.posexplode("delta").alias("i", "t")).select("a", "b", "apart", "t", (F.col("i") >= F.col("fresh")).alias("gone"))
    df = each.groupBy("a", "t").agg(F.count(F.lit(1)).alias("df"), F.max("apart").alias("tells")).where("df > 1 and tells").drop("tells")
    # for a linked y: d(x) > c (n(x) + n(h)) and n(h) - n(y) >= -d(y), so more than d(y) (1 - c) / 2 are shared
    keep = F.expr(f"if(linked, d - floor(d * {2 * percent} / {2 * total}), d - ceil(greatest(d + greatest(1, d - most) - most, 2) / 2) + 1)").cast("int")
    shared_ = each.join(df, ["a", "t"]).groupBy("a", "b").agg(
        F.sort_array(F.collect_list(F.struct("gone", "df", "t"))).alias("common"), F.count_if(~F.col("gone")).alias("new_common"))
    ranked = open_.withColumn("keep", F.greatest(keep, F.lit(0))).withColumn(
        "lost", F.col("d") - F.col("fresh")).drop("delta").join(shared_, ["a", "b"])
    # The order of a difference: what is new before what is gone; in either, tokens that no node apart shares first
    # (they meet nothing), then by number of members.
    at = lambda gone, i: F.when(gone, F.col("d") - F.size("common") + i).otherwise(F.col("d") - F.col("lost") - F.col("new_common") + i)
    placed = F.transform("common", lambda x, i: F.struct(x["t"].alias("t"), x["gone"].alias("gone"), at(x["gone"], i).alias("at")))
    numbered = ranked.withColumn("first", F.filter(placed, lambda x: x["at"] < F.col("keep")))
    index = numbered.select("a", "b", "n", "comp", "apart", "d", "linked", "fresh", "lost", F.explode("first").alias("x")).select("*", "x.*").drop("x")
    index = pin(index, release=True)
    other = index.select("a", "t", *[F.col(k).alias(f"{k}2") for k in ("b", "n", "comp", "apart", "d", "linked", "fresh", "lost", "at")])
    need = F.expr(f"d + d2 - floor({per} * (n + n2) / {total})")
    # It suffices that the first shared token in the order meets. From it on, both must have as many tokens as
    # must be shared: new ones from its place and gone ones, or, if it is a gone one itself, gone ones from its place.
    left = lambda x: F.when(F.col("gone"), F.col(f"d{x}") - F.col(f"at{x}")).otherwise(F.col(f"fresh{x}") - F.col(f"at{x}"))
    rest = F.least(left(""), left("2")) + F.when(F.col("gone"), 0).otherwise(F.least("lost", "lost2"))
    met = index.where("apart").join(other, ["a", "t"]).where(
        (~F.col("apart2") | (F.col("b") < F.col("b2"))) & (F.col("comp") != F.col("comp2"))
        & (2 * rest >= need)
        & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")))
    asked = met.select("a", "b", "b2").distinct()
    one = open_.select("a", "b", "n", "d", "delta")
    two = one.select("a", F.col("b").alias("b2"), F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("delta").alias("delta2"))
    checked = asked.join(one, ["a", "b"]).join(two, ["a", "b2"])
    out = pin(checked.where(F.expr(f"d + d2 - 2 * size(array_intersect(delta, delta2)) <= floor({per} * (n + n2) / {total})")).select(F.col("b").alias("a"), F.col("b2").alias("b")), release=True)
    release(open_)
    release(index)
    return out


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own without any)."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {percent}, not {LEAST_PERCENT} to 100")
    every = bounded(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    d = every.where("doc_id is not null")
    named = pin(nodes(every, k))
    sized = pin(named.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("_id"), F.min("n").alias("n")))
    met = pin(_met(prefixes(d, k, percent), percent), release=True)
    # Linked prefixes share so many tokens: those that are not rare are frequent ones of both nodes.
    touched = pin(met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("f")).join(sized, "node"))
    side = lambda x: touched.select(F.col("node").alias(x), F.col("f").alias(f"f{x}"))
    size = lambda x: sized.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("_id").alias(f"id_{x}"))
    some = lambda x: F.coalesce(x, F.lit(0))
    rare = met.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    rare = rare.join(size("a"), "a").join(size("b"), "b").join(side("a"), "a", "left").join(side("b"), "b", "left").where(
        F.col("c") + F.least(some("fa"), some("fb")) >= shared(F.least("na", "nb")))
    rare = pin(rare.select("a", "b", "id_a", "id_b"), release=True)
    release(met)
    many = touched.where(F.col("f") >= shared(F.floor(F.col("n") * percent / 100))).select("node", "_id")
    wanted = rare.select(F.col("a").alias("want"), F.col("id_a").alias("_id")).union(rare.select("b", "id_b")).union(many).distinct()
    # one document stands for each wanted node; only their texts are read again
    stand = pin(wanted)
    # The ids grow with the documents: the same join at every size, no broadcast while they are few.
    token_sets = pin(_token_sets(d.join(stand.hint("merge"), d["doc_id"] == stand["_id"]).select("doc_id", "text", "want"), k), release=True)
    keys = pin(_combinations(token_sets.join(many.select(F.col("_id").alias("node")), "node", "left_semi"), percent), release=True)
    held = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    owned = pin(keys.join(held, "key"), release=True)
    release(keys)
    few = owned.where(F.col("c") <= RARE).select("key", "node")
    direct = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    crowd = owned.where(F.col("c") > RARE)
    liked = pin(crowd.groupBy("node").agg(F.sum("c").alias("liked")))
    hubs = crowd.join(liked, "node").groupBy("key").agg(F.max(F.struct("liked", "node"))["node"].alias("hub"))
    held_by = pin(crowd.join(hubs, "key").join(liked.withColumnRenamed("node", "hub"), "hub").select("node", "hub", "liked").distinct(), release=True)
    # A hub that has a better one itself hands its nodes on, so that a group of near copies meets at one node. Any node may be a hub.
    better = held_by.groupBy("node").agg(F.max(F.struct("liked", "hub"))["hub"].alias("a")).withColumnRenamed("node", "hub")
    star = held_by.join(better, "hub").where("node != a").select("a", F.col("node").alias("b")).distinct()
    low, high = F.least("id_a", "id_b"), F.greatest("id_a", "id_b")
    near = direct.union(rare.where("id_a != id_b").select(low.alias("a"), high.alias("b"))).distinct()
    pairs = pin(star.withColumn("hub", F.lit(True)).unionByName(near.withColumn("hub", F.lit(False))), release=True)
    release(owned)
    # Every pair brings the tokens of a to those of b, and a hub's differences are as large as its members: round by round.
    held_tokens = token_sets.agg(F.sum("n")).first()[0]
    moved = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")).join(token_sets.select(F.col("node").alias("a"), "n"), "a").agg(F.sum(F.col("c") * F.col("n"))).first()[0]
    checked = _in_rounds(pairs, "b", _rounds(moved, held_tokens, PAIRS_SHARE), lambda part, own: pin(_differences(part, token_sets, own(token_sets, "node"), percent), release=True))
    release(token_sets)
    links = checked.where("linked").select("a", "b")
    comp = pin(components(links))
    hubs_only = checked.where("hub")
    told = hubs_only.agg(F.sum(F.size("delta").cast("bigint"))).first()[0]
    more = _in_rounds(hubs_only, "a", _rounds(told, held_tokens, REST_SHARE), lambda part, own: _rest(part, comp, percent))
    if not more.isEmpty():
        comp = pin(components(links.unionByName(more)))
    # Nodes bear their smallest doc_id, so a component's smallest node is the component_id.
    of = sized.join(comp.select(F.col("node").alias("_id"), "component"), "_id", "left").select("node", F.coalesce("component", "_id").alias("of"))
    return named.join(of, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("of")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The documents without those linked, directly or not, to one with a smaller id; all columns kept."""
    out = pin(join(docs, doc_id, text, k, percent).where("component_id != doc_id").select(F.col("doc_id").alias("gone")))
    return docs.join(out, docs[doc_id] == out["gone"], "left_anti")
