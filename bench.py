"""Seconds per headline query on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)  # for Python workers

from pyspark.sql import SparkSession  # noqa: E402

from emberwatch.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "parse_syslog", "parse_lines", "src_ip_documents", "rolling_count", "rolling_distinct", "rolling_sum", "cooldown",
    "ewma_baseline", "brute_force", "port_scan", "exfil", "new_admin", "auth_spike", "forwarded_finding", "detect_all",
    "killchain_success", "upsert_detections", "finding_write", "reconcile_state", "active_findings", "diff_findings",
    "digest_text", "alert_lines", "findings_view", "normalize_domain", "verify_challenges",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("emberwatch-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", "1m")  # the test tables are single small files
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["actor"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the executors
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
