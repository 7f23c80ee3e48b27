"""Some catalog queries against their SQL on the smallest test tables (tools/check.py runs them all)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
from check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ("parse_syslog", "rolling_distinct", "cooldown", "brute_force", "forwarded_finding", "upsert_detections",
          "reconcile_state", "diff_findings", "digest_text", "alert_lines", "verify_challenges")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_agrees_with_sql(spark, name):
    text, ok = compare(spark, connect(SF_DIR), name, SF_DIR, contract.queries()[name], contract.oracle_sql()[name])
    assert ok, text


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
