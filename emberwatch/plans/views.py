"""The test tables seen as log events, raw lines, detection records and a source registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberwatch.model import EVENT_SCHEMA, RECORD_SCHEMA, columns
from emberwatch.operators.records import fix_for
from emberwatch.plans.lineage import prepare


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A test table; times there carry no zone and are read as UTC."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if table == "events" else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, uid = load(spark, sf_dir, "events"), F.col("user_id")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "ts", F.col("event_id").alias("seq"), F.lit("file").alias("source"),
        F.concat(F.lit("src"), (uid % 5).cast("string")).alias("source_id"),
        F.concat(F.lit("web"), (uid % 5).cast("string")).alias("host"), F.lit("sshd").alias("app"),
        F.lit(6).alias("severity"), F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("message"),
        F.when(kind == "error", "failure").when(kind == "purchase", "success").otherwise("").alias("auth"),
        F.concat(F.lit("u"), uid.cast("string")).alias("user"),
        F.concat(F.lit("10.0."), F.floor(uid / 256).cast("string"), F.lit("."), (uid % 256).cast("string")).alias("src_ip"),
        (k + 20).alias("dst_port"),
        (F.round(F.col("value") * 100).cast("bigint") * 10000).alias("bytes_out"),
        F.when((kind == "signup") & (k < 10), "new_admin").otherwise("").alias("action"),
        F.concat(F.lit("ev "), F.col("event_id").cast("string"), F.lit(" "), kind).alias("raw"),
        (k >= 35).alias("parsed"),
    ).select(*columns(EVENT_SCHEMA))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event written as a log line in one of five shapes, for the parsers."""
    e, uid = load(spark, sf_dir, "events"), F.col("user_id").cast("string")
    ts, kind, n = F.col("ts"), F.col("event_type"), F.col("event_id").cast("string")
    bsd = F.concat(F.date_format(ts, "MMM "), F.lpad(F.dayofmonth(ts).cast("string"), 2, " "), F.date_format(ts, " HH:mm:ss"))
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    line = (
        F.when(kind == "error", c("<38>", bsd, " web1 sshd[", n, "]: Failed password for invalid user u", uid, " from 10.0.0.", uid, " port 2200 ssh2"))
        .when(kind == "purchase", c("<38>", bsd, " web2 sshd: Accepted password for u", uid, " from 10.0.1.9 port ", n, " ssh2"))
        .when(kind == "signup", c("<86>1 ", iso, " web3 useradd ", n, " - [meta seq=\"", n, "\"] new user: name=u", uid, ", home=/home/u"))
        .when(kind == "click", c("<134>1 ", iso, " fw1 - - - - OUT=eth0 SRC=192.168.7.", uid, " DPT=", n, " bytes=", cents, " deny"))
        .otherwise(c("10.1.2.3 - - \"GET /item/", n, "\" 200 sent=", cents))
    )
    return e.select(
        line.alias("value"), F.timestamp_seconds(F.lit(1706745600)).alias("recv_ts"), F.col("event_id").alias("seq"),
        F.lit("syslog").alias("source"), F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source_id"),
        F.lit("").alias("host"), F.lit("").alias("app"),
    )


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with messages that are findings another tool forwarded."""
    k = F.col("dst_port") - 20
    product = F.when(k % 3 == 0, "trap").otherwise("rules")
    level = F.when(k % 4 == 0, "critical").when(k % 4 == 1, "high").otherwise("low")
    status = F.when(k % 10 == 9, "resolved").otherwise("open")
    message = F.concat(
        F.lit("bait | product="), product, F.lit(" severity="), level, F.lit(" check=c."), (k % 7).cast("string"),
        F.lit(" target=t status="), status, F.lit(" src="), F.col("src_ip"))
    return events(spark, sf_dir).withColumn("message", message)


def forwarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without logins."""
    return mixed(spark, sf_dir).withColumn("auth", F.lit(""))


SPLIT = "timestamp '2024-01-16 00:00:00'"
NOW = "timestamp '2024-01-31 00:00:00'"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``events`` as detection records, in the layout of the keyed table."""
    e, k = events(spark, sf_dir), F.col("dst_port") - 20
    kind = F.when(F.col("auth") == "failure", "brute_force").otherwise("new_admin")
    return e.select(
        "source_id", F.concat(kind, F.lit("|"), F.col("user"), F.lit("|"), (k % 20).cast("string")).alias("key"),
        F.concat(F.lit("detect."), kind).alias("check"),
        F.when(k < 10, "critical").when(k < 30, "high").when(k < 60, "medium").when(k < 95, "low").otherwise("odd").alias("severity"),
        F.col("src_ip").alias("actor"), F.when(k % 2 == 0, F.col("host")).otherwise("").alias("target"),
        F.when(k == 50, "").otherwise(F.concat(F.lit("T "), F.col("raw"))).alias("title"),
        F.concat(F.lit("k="), k.cast("string")).alias("detail"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("raw")).alias("evidence"),
        fix_for(kind).alias("fix"), k.cast("bigint").alias("count"),
        (F.col("ts") - F.make_dt_interval(mins=k)).alias("first_at"), F.col("ts").alias("last_at"), "seq", F.lit(1).alias("ord"),
    ).select(*columns(RECORD_SCHEMA))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry derived from ``events``: src0..src3 of the five source ids that occur."""
    e = events(spark, sf_dir).where("source_id != 'src4'")
    tail = F.substring("source_id", 4, 1).cast("int")
    return e.groupBy("source_id").agg(F.min("ts").alias("created_at")).select(
        F.col("source_id").alias("name"),
        F.element_at(F.array(*[F.lit(t) for t in ("file", "syslog", "journald", "docker")]), tail + 1).alias("type"),
        F.create_map(F.lit("path"), F.concat(F.lit("/logs/"), F.col("source_id"))).alias("params"),
        F.lit(True).alias("enabled"), "created_at",
    )
