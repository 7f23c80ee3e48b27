"""Line dedup by site-relative frequency.

Lines are compared without the white space around them, tabs counting as spaces. A line is boilerplate of a host if more than
``ratio`` of the host's pages hold it and at least ``min_pages`` do; these lines are dropped from the
host's pages, all other lines stay as they are and in order.

Defined cases: blank lines are never boilerplate; a line repeated inside a page counts once for the
page; a null host is a host of its own; a null text stays null and counts as a page; a text of which
every line is dropped becomes empty; a page id that occurs twice counts as two pages, told apart by
nothing but the row, so pages are counted per row. Extra columns are kept. With ``per_text`` the equal texts
of a host count as one page, so that copies do not make their own lines boilerplate; lines are dropped
from all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.llm.names import fresh
from emberwatch.plans.lineage import pin

#: Share of a host's pages, and least number of pages, that make a line boilerplate.
RATIO, MIN_PAGES = 0.08, 5


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r", "  "))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, per_text: bool = False) -> DataFrame:
    """(_host, _drop): per host the sorted hashes of its boilerplate lines.

    A host has at most (lines per page) / ratio of them, however many pages it has. Lines are counted
    by host and hash: combined before the shuffle, a line in every page is a few rows.
    """
    rows = pages.select(F.col(host).alias("_host"), F.col(text).alias("_t"))
    kept = F.array_distinct(F.transform(F.filter(_lines(F.col("_t")), lambda x: _key(x) != ""), lambda x: F.xxhash64(_key(x))))
    if per_text:  # only the lines' hashes travel
        rows = rows.groupBy("_host", F.xxhash64("_t").alias("_h"), F.length("_t").alias("_l")).agg(F.first(kept).alias("_k"))
        kept = F.col("_k")
    totals = rows.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    seen = rows.select("_host", F.explode(kept).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    often = seen.where(F.col("_n") >= min_pages).join(totals, seen["_host"].eqNullSafe(totals["_host"])).where(F.col("_n") > F.col("_pages") * F.lit(ratio))
    return often.groupBy(seen["_host"].alias("_host")).agg(F.sort_array(F.collect_list("_line")).alias("_drop"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, per_text: bool = False) -> DataFrame:
    """``pages`` without boilerplate lines, plus ``n_dropped`` (long): lines taken out of the page.

    If the pages have a column of that name already, the new one gets an underscore in front.
    """
    key, gone, n = fresh(pages, "_dhost", "_drop", "n_dropped")
    # Written once: its size is then known, and the planner broadcasts it only if it is small.
    drop = pin(boilerplate(pages, host, text, ratio, min_pages, per_text)).select(F.col("_host").alias(key), F.col("_drop").alias(gone))
    joined = pages.join(drop, F.col(host).eqNullSafe(F.col(key)), "left")
    lines = _lines(F.col(text))
    hit = lambda x: (_key(x) != "") & F.array_contains(gone, F.xxhash64(_key(x)))
    kept = F.filter(lines, lambda x: ~hit(x))
    clean = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(gone).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(kept)).cast("bigint")
    return joined.select(*[clean.alias(c) if c == text else F.col(c) for c in pages.columns], count.alias(n))


def oracle(table: str = "documents", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    key = "trim(translate(l, chr(9) || chr(13), '  '))"
    return f"""
with pages as (select row_number() over () as r, doc_id, source, text from {table}),
lines as (select r, doc_id, source, g.i as i, string_split(text, chr(10))[g.i] as l
          from pages, lateral (select unnest(generate_series(1, len(string_split(text, chr(10))))) as i) g where text is not null),
often as (select source, {key} as k from lines where {key} <> '' group by source, {key}
          having count(distinct r) >= {min_pages}
             and count(distinct r) > {ratio} * (select count(*) from pages p where p.source is not distinct from lines.source)),
marked as (select r, i, l, exists (select 1 from often o where o.source is not distinct from lines.source and o.k = {key} and {key} <> '') as gone from lines),
kept as (select r, string_agg(l, chr(10) order by i) filter (where not gone) as t, count(*) filter (where gone) as n from marked group by r)
select p.doc_id as doc_id, p.source as source, case when p.text is null then null else coalesce(k.t, '') end as text, coalesce(k.n, 0) as n_dropped
from pages p left join kept k on p.r = k.r"""
