"""From raw documents to packed training sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberwatch.llm import decontaminate, langid, ngram_join, packing, site_lines
from emberwatch.llm.names import fresh
from emberwatch.llm.queries import held_out, tokenizer_path
from emberwatch.plans.lineage import shared_folder

#: Documents whose language is less certain than this go, like those without any.
MIN_SCORE = 0.5
#: Near copies: words of a shingle, least Jaccard similarity in percent.
NEAR_K, NEAR_PERCENT = 5, 80
#: Words that a packing task remembers; workers are shared with the other stages.
PACK_ROOM = 250_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language. Null and letterless texts go."""
    lang, score = fresh(docs, "lang_pred", "score")
    seen = langid.identify(docs, ~held_out(), keep=tuple(docs.columns), names=(lang, score))
    return seen.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    Copies are still in, so equal texts count once: what only copies repeat is content, not boilerplate.
    """
    clean, (dropped,) = site_lines.drop_boilerplate(docs, per_text=True), fresh(docs, "n_dropped")
    return clean.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest id."""
    return ngram_join.keep_one(docs, k=NEAR_K, percent=NEAR_PERCENT)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every remaining document goes."""
    return packing.pack(docs, tokenizer_path(), room=PACK_ROOM)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("packed", packed),
]

#: Trained language statistics and token ids are no SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
