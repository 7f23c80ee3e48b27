"""Every stage of the pipeline against a plain version of what it keeps, on the smallest test tables."""

import os
import random

import pytest

import corpus_pipeline
from emberwatch.llm import decontaminate, langid, ngram_join, site_lines

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()
    columns, texts = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs.toPandas(), stage(spark, docs, SF_DIR).cache()
        after = out.toPandas()
        if name == "packed":
            assert set(after.doc_id) == set(before.doc_id) and (after.groupby("sequence_id").length.sum() <= 4096).all()
            break
        assert list(after.columns) == columns
        if name == "language":
            assert set(before.doc_id) - set(after.doc_id) == {r.doc_id for r in before.itertuples() if not any(c.isalpha() for c in r.text or "")}
        elif name == "lines":
            hosts = before.groupby("source").size().to_dict()
            seen = {}
            for r in before.itertuples():
                for k in {x.strip() for x in r.text.split("\n")} - {""}:
                    seen[r.source, k] = seen.get((r.source, k), 0) + 1
            bad = {k for k, n in seen.items() if n >= site_lines.MIN_PAGES and n > site_lines.RATIO * hosts[k[0]]}
            want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if (r.source, x.strip()) not in bad) for r in before.itertuples()}
            assert dict(zip(after.doc_id, after.text)) == want
        elif name == "near_copies":
            groups = {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()}
            assert set(after.doc_id) == set(groups.values())
        elif name == "benchmark_free":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            leaking = {r.doc_id for r in before.itertuples() if any(i in " ".join(r.text.lower().split()) for i in items)}
            assert set(before.doc_id) - set(after.doc_id) == leaking
        docs = out


def test_run_gives_the_last_stage(spark):
    if os.path.isdir(SF_DIR):
        assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, SF_DIR).columns)


def test_copies_do_not_make_boilerplate(spark):
    copied = "\n".join(f"copied sentence number {i} with words of its own" for i in range(6)) + "\nfooter"
    texts = [copied] * 30 + [f"page {i} tells story {i * 7}\nand ends with line {i}\nfooter" for i in range(60)] + ["one line only"] * 5
    rows = [(i, t, "en", "host", len(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, "small host, one line", "en", "small", 20) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clean = corpus_pipeline.lines(spark, docs, "").cache()
    left = {r.doc_id: r.text for r in corpus_pipeline.near_copies(spark, clean, "").collect()}
    assert left[0] == copied.removesuffix("\nfooter") and left[90] == "one line only" and left[1000] == "small host, one line"
    assert not set(left) & {*range(1, 30), *range(91, 95), *range(1001, 1005)}
    assert left[30] == "page 0 tells story 0\nand ends with line 0"


def test_near_copies_are_those_of_five_words_and_four_fifths(spark):
    r = random.Random(6)
    texts = []
    for n in (9, 24, 49, 50, 51, 52, 80, 110, 160, 240):  # one changed word in about 50 links by five words, not by four
        for group in range(3):
            base = [f"w{n}x{group}x{i}" for i in range(n)]
            texts.append(" ".join(base))
            for _ in range(25 if group == 2 else 3):
                t = list(base)
                for _ in range(r.randint(1, max(1, n // 40))):
                    t[r.randrange(n)] = f"v{r.randrange(9)}"
                texts.append(" ".join(t))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    first = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and first[i] != first[j]:
                low, high = sorted((first[i], first[j]))
                first = [low if x == high else x for x in first]
    assert {x.doc_id for x in corpus_pipeline.near_copies(spark, docs, "").collect()} == set(first)
    assert set(first) != {x.component_id for x in ngram_join.join(docs).collect()}
