"""Violations are written part by part, and no part is broadcast however small its files are."""

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import contracts, evidence
from sheetwise.session import BROADCAST, by_shuffle, gather


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_inside_are_not_broadcast(spark):
    a, b = spark.range(9), spark.range(9).withColumn("x", F.lit(1))
    before = [spark.conf.get(key, None) for key in BROADCAST]
    with pytest.raises(ValueError), by_shuffle(spark):
        assert "BroadcastHashJoin" not in joins(a.join(b, "id"))
        assert "BroadcastHashJoin" in joins(a.join(b.hint("broadcast"), "id"))
        raise ValueError
    assert [spark.conf.get(key, None) for key in BROADCAST] == before


def test_gather_keeps_repeated_rows_of_all_parts(spark):
    parts = [spark.sql("SELECT 'a' AS k, 1 AS n"), spark.sql("SELECT 1 AS n, 'a' AS k"), spark.sql("SELECT 'b' AS k, 2 AS n WHERE false")]
    assert sorted(map(tuple, gather(parts).collect())) == [("a", 1), ("a", 1)]


def test_violations_are_a_table_without_joins(spark):
    """The result is read back: asking for it does not plan all rules as one query."""
    jobs = spark.sql("SELECT 'j' AS job_id, 'verified' AS status, 'x' AS candidateSha256, 'x' AS sourceSha256")
    record = jobs.select("*", *(F.lit("x").alias(c) for c in evidence.BOUND.values()))
    files = spark.createDataFrame([("j", n, "x") for n in (*evidence.BOUND, "candidate.dwg")], "job_id string, name string, sha256 string")
    found = evidence.delivery_rules(record, files, spark.sql("SELECT 'j' AS job_id, 'y' AS sha256"), spark.sql("SELECT 'j' AS job_id, 'x' AS sha256"))
    assert "Join" not in joins(found)
    assert [tuple(r) for r in found.select("rule", "detail").collect()] == [("FN7", "sourceSha256 changed")]
    assert found.columns == contracts.VIOLATIONS
