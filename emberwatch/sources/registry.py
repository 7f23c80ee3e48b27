"""The table of configured sources: validation and upsert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from emberwatch.functions.text import strip_space
from emberwatch.sources.lines import parse_source, read_lines

SOURCE_COLUMNS = ["name", "type", "params", "enabled", "created_at"]


def source_error(name: Column, kind: Column, params: Column) -> Column:
    """Why a source cannot be used, or NULL."""
    given = lambda key: F.coalesce(F.try_element_at(params, F.lit(key)), F.lit("")) != ""
    listens = given("udp") | given("tcp")
    return (
        F.when(strip_space(name) == "", "the name is empty")
        .when(kind.isin("syslog", "windows") & ~listens, F.concat(
            kind, F.lit(": give an address to listen on as udp or tcp")))
        .when((kind == "file") & ~given("path"), "file: give its path")
        .when((kind == "docker") & ~given("container"), "docker: give the container")
        .when(~kind.isin("syslog", "windows", "file", "docker", "journald"),
              F.concat(F.lit("no such type: "), kind))
    )


def validate_sources(requests: DataFrame) -> DataFrame:
    """Trim the name and add ``error`` (NULL when fine)."""
    error = source_error(F.col("name"), F.col("type"), F.col("params"))
    return requests.withColumn("error", error).withColumn("name", strip_space(F.col("name")))


@dataclass
class Saved:
    sources: DataFrame
    refused: DataFrame


def put_sources(current: DataFrame, requests: DataFrame, now: Column, limit: int = 0) -> Saved:
    """Insert or overwrite by name (created_at of an existing source stays).

    requests: (name, type, params, seq). With a ``limit`` new names are admitted in order of their
    first request while fewer sources exist; the registry is a small dimension table.
    """
    checked = validate_sources(requests)
    bad = checked.where("error is not null").select("name", "type", "params", "seq", "error")
    good = checked.where("error is null").groupBy("name").agg(
        F.max_by(F.struct("type", "params"), "seq").alias("_x"), F.min("seq").alias("_first"))
    old = current.select("name", F.struct("created_at").alias("_old"), F.struct(*SOURCE_COLUMNS).alias("_all"))
    both = good.join(old, "name", "full_outer")
    full = F.lit(False)
    if limit:
        fresh = F.col("_old").isNull()
        order = W.partitionBy(fresh).orderBy("_first")
        have = current.agg(F.count(F.lit(1)).alias("_have"))
        both = both.withColumn("_rank", F.row_number().over(order)).crossJoin(have)
        full = fresh & (F.col("_have") + F.col("_rank") > limit)
    both = both.withColumn("_full", full)
    kept = both.where(~F.col("_full")).select(
        "name", F.coalesce("_x.type", "_all.type").alias("type"), F.coalesce("_x.params", "_all.params").alias("params"),
        F.when(F.col("_x").isNotNull(), F.lit(True)).otherwise(F.col("_all.enabled")).alias("enabled"),
        F.coalesce("_old.created_at", now).alias("created_at"))
    over = both.where("_full").select(
        "name", "_x.type", "_x.params", F.col("_first").alias("seq"),
        F.lit("no room for another source").alias("error"))
    return Saved(kept, bad.unionByName(over))


def build_source(spark: SparkSession, name: str, kind: str, params: dict[str, str], received: Column | None = None,
                 landed: str | None = None) -> DataFrame:
    """Events of one configured source, of any type that ``source_error`` accepts.

    Its lines are read from ``landed``: where captured datagrams, a container's log or the export of a
    journal (of its ``unit`` only, as the export tool was told) are put. A file source has its own path.
    """
    path = landed or params.get("path")
    if not path:
        raise ValueError(f"say where the lines of {name} ({kind}) have landed")
    app = params.get("container", "") if kind == "docker" else params.get("app", "")
    return parse_source(read_lines(spark, path, name, kind, params.get("host", ""), app, received), kind)
