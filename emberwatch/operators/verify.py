"""Domain ownership: match challenges with observed DNS records and HTTP bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberwatch.functions.text import strip_space

# Fixed formats.
DNS_PREFIX = "_sentinel-verify."
TOKEN_PREFIX = "sentinel-verify="
HTTP_PATH = "/.well-known/sentinel-verify.txt"


def normalize_domain(c: Column) -> Column:
    """``HTTPS://Example.com:443/x`` and ``example.com.`` both become ``example.com``."""
    s = strip_space(F.lower(c))
    s = F.regexp_replace(s, r"(?s)^.*?://", "")
    s = F.regexp_replace(s, r"(?s)[/?#].*$", "")
    s = F.when(s.contains("]"), s).otherwise(F.regexp_replace(s, r"(?s):[^:]*$", ""))
    return F.regexp_replace(s, r"\.\z", "")


def verify_challenges(challenges: DataFrame, txt_records: DataFrame, http_bodies: DataFrame) -> DataFrame:
    """Add ``verified`` and ``method`` (dns wins over http) to (domain, token, ...).

    txt_records: (name, value), any number per name; http_bodies: (url, body). Only proofs that
    match survive the aggregation, so a name with very many records adds at most one row.
    """
    want = F.concat(F.lit(TOKEN_PREFIX), F.col("token"))
    asked = challenges.withColumns({
        "_want": want,
        "_name": F.concat(F.lit(DNS_PREFIX), F.col("domain")),
        "_url": F.concat(F.lit("http://"), F.col("domain"), F.lit(HTTP_PATH)),
    })
    dns = txt_records.select(F.col("name").alias("_name"), strip_space(F.col("value")).alias("_want")).distinct()
    web = http_bodies.select(F.col("url").alias("_url"), strip_space(F.col("body")).alias("_want")).distinct()
    found = (
        asked.join(dns.withColumn("_dns", F.lit(True)), ["_name", "_want"], "left")
        .join(web.withColumn("_web", F.lit(True)), ["_url", "_want"], "left")
    )
    method = F.when(F.col("_dns"), "dns").when(F.col("_web"), "http").otherwise("")
    return found.withColumn("method", method).withColumn("verified", F.col("method") != "").select(
        *challenges.columns, "verified", "method")


def pending(challenges: DataFrame) -> DataFrame:
    return challenges.where("state != 'verified'")
