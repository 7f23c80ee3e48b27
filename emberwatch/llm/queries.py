"""The registered queries of the operators and the SQL they agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberwatch.llm import decontaminate, langid, ngram_join, packing, passages, pii, quality, repeats, site_lines, spellings, turns, url_rules, vafile

#: The rules of the URL query: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """Whether the id is in the quarter that trains nothing."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return langid.identify(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op4_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_lines.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.remove_repeats(_table(spark, sf_dir, "documents")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op9_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, F.col("vec_id") % 50 == 0)


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(_table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings.variants(spellings.vocabulary(_table(spark, sf_dir, "documents")))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.digest(turns.damage(_table(spark, sf_dir, "conversations")))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return quality.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fifth)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontaminate, op2_packing, op3_language, op4_site_lines, op5_passages,
    op6_ngram_join, op7_repeats, op8_pii, op9_vafile, op10_url_rules,
    op11_spellings, op12_turns, op13_quality,
)}

_VAFILE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and vec_id is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, c.vec_id as vec_id,
                  cast(list_sum(list_transform(generate_series(1, least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) as bigint) as score
           from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5"""

# No page of the tables has a canonical or redirect link, so the rules alone decide there.
_URL_RULES = """
with p as (select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), '') as h, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path from pages),
q as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
r(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (select page_id, max(struct_pack(n := length(rh || rp), rule := rh || rp, verdict := verdict)) as best
         from q join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select q.page_id as page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') as verdict from q left join fits on q.page_id = fits.page_id"""

# CRC-32 from its rule: a table of 256 steps, and the checksum of a list of byte values.
_CRC_TABLE = """steps(i, k, c) as (select i, 0, i from range(256) t(i)
    union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc(l) as (select list(c order by i) from steps where k = 8)"""


def _crc(values: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {values}), lambda c, b: xor(c >> 8, l[(xor(c, b) & 255) + 1])), 4294967295)"


_SPELLINGS = f"""
with recursive {_CRC_TABLE},
runs as (select coalesce(cast(doc_id as varchar), '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
counted as (select d, run, count(*) as n from runs group by all),
hashed as (select run, n, {_crc("flatten(list_transform(string_split(d || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end))")} as h from counted, crc),
spoiled as (select case when h % 97 = 0 then left(run, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, n from hashed),
w as (select word, cast(sum(n) as bigint) as n from spoiled where length(word) >= 5 group by word having sum(n) >= 3),
less as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as part from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
met as (select a.word as a, b.word as b, b.n as nb from less a join w b on a.part = b.word
  union select b.word, a.word, a.n from less a join w b on a.part = b.word
  union select a.word, b.word, b.n from less a join less b on a.i = b.i and a.part = b.part and a.word <> b.word),
best as (select a, count(*) as n_near, arg_min(b, (-nb, encode(b))) as b, max(nb) as nb from met group by a),
told as (select word, n, coalesce(n_near, 0) as n_near, case when nb >= 2 * n then b end as form, case when nb >= 2 * n then nb end as form_n from w left join best on word = a),
walk(word, pos) as (select word, word from told union all select walk.word, told.form from walk join told on walk.pos = told.word where told.form is not null),
roots as (select walk.word, walk.pos as root from walk join told on walk.pos = told.word where told.form is null)
select word, form, root, n, n_near, form_n from told join roots using (word)"""

# The cheapest audit by walking the rows: per state the least (cost, audit), inserts tried before every row and at the end.
_TURNS = f"""
with recursive {_CRC_TABLE},
given as (select conv_id, cast(turn as bigint) as turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  {_crc("list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: unicode(x)::bigint)")} % 20 as k from conversations, crc),
broken as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
  case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when k = 3 then 2 else 1 end)) as copy from given where k <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || ':' || text), copy) as pos from broken),
faulty as (select *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') as inked, row_number() over (partition by conv_id, role, text order by pos) as time, left(role, 1) as i,
  lag(left(role, 1)) over (partition by conv_id order by pos) as before from placed),
marked as (select *, case when inked = '' then 3 when time > 1 then 2 when right(inked, 1) not in ('.', '!', '?') then 1 else 0 end as fault from faulty),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 3) as blank, count(*) filter (fault = 2) as duplicate,
  count(*) filter (fault = 1) as truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, count(*) as last from marked group by conv_id),
nexts(p, q, w) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
puts as (select p, p as q, 0 as cost, '' as audit, '' as made from nexts union all select p, q, 2, 'I', chr(10) || w || ':' from nexts
  union all select a.p, b.q, 4, 'II', chr(10) || a.w || ':' || chr(10) || b.w || ':' from nexts a join nexts b on a.q = b.p),
walk(conv_id, pos, state, cost, audit, made) as (
  select distinct conv_id, 0::bigint, 0, 0, '', '' from conversations
  union all
  select conv_id, pos, (best).state, (best).cost, (best).audit, (best).made from (
    select conv_id, pos, arg_min(struct_pack(state := state, cost := cost, audit := audit, made := made), (cost, audit)) as best from (
      select w.conv_id, m.pos, e.q as state, w.cost + puts.cost + e.cost as cost, w.audit || puts.audit || e.letter as audit, w.made || puts.made || e.made as made
      from walk w join marked m on m.conv_id is not distinct from w.conv_id and m.pos = w.pos + 1 join puts on puts.p = w.state,
      lateral (select puts.q as q, 3 as cost, 'D' as letter, '' as made
        union all select n.q, 2 + m.fault, 'R', chr(10) || n.w || ':' || m.text from nexts n where n.p = puts.q and m.fault < 2
        union all select n.q, m.fault, 'K', chr(10) || m.role || ':' || m.text from nexts n where n.p = puts.q and m.fault < 2 and m.i = left(n.w, 1)
        union all select 1, m.fault, 'K', chr(10) || m.role || ':' || m.text where puts.q = 0 and m.fault < 2 and m.i = 's') e) group by conv_id, pos, state)),
done as (select w.conv_id, arg_min(struct_pack(cost := w.cost + puts.cost, audit := w.audit || puts.audit, made := w.made || puts.made), (w.cost + puts.cost, w.audit || puts.audit)) as best
  from walk w left join facts f on f.conv_id is not distinct from w.conv_id join puts on puts.p = w.state where w.pos = coalesce(f.last, 0) and puts.q in (0, 3) group by w.conv_id)
select d.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast((best).cost as bigint) as cost, (best).audit as audit, sha256(substr((best).made, 2)) as repaired_sha256
from done d left join facts f on f.conv_id is not distinct from d.conv_id"""

EXPECTED: dict[str, str] = {
    "op4_site_lines": site_lines.oracle(),
    "op9_vafile": _VAFILE,
    "op10_url_rules": _URL_RULES,
    "op11_spellings": _SPELLINGS,
    "op12_turns": _TURNS,
}
