"""Tables of jobs are dealt out by job once: what joins and groups a job's rows finds them in place."""

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import contracts, evidence
from sheetwise.plans import records
from sheetwise.session import by_shuffle, dealt
from sheetwise.sources import schemas
from sheetwise.sources.artifacts import section

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def counted(frames):
    with by_shuffle(frames[0].sparkSession):
        return [shuffles(df.select("*")) for df in frames]


@pytest.fixture
def written(monkeypatch):
    """Shuffles in the plan of each frame of violations."""
    seen, write = [], contracts.gather
    monkeypatch.setattr(contracts, "gather", lambda frames: (seen.append(counted(frames)), write(frames))[1])
    return seen


def test_fields_taken_at_once_are_those_taken_one_by_one(spark):
    items = """array(parse_json('{"handle":1,"row":"x","position":[1,"a"],"worldBoxes":[{"root":3,"box":{"a":1}}],"kind":null}'), parse_json('5'), parse_json('null'),
        parse_json('{"height":"2.5","visible":"yes","color":1e30,"raw":{"a":1},"box":5,"position":[[1]]}'))"""
    docs = spark.sql(f"SELECT 'j' AS job_id, {items} AS rows")
    names = tuple(name for name, _ in schemas.fields(schemas.ROW))
    told = lambda df: df.withColumn("body", F.to_json("body")).collect()
    assert told(section(docs, "rows", (*names, "body"))) == told(section(docs, "rows"))
    assert section(docs, "rows", ("raw",)).columns == ["job_id", "ordinal", "raw"]


def test_dealt_tables_meet_without_a_shuffle(spark):
    jobs = spark.range(50).selectExpr("cast(id AS string) AS job_id", "array(id, id + 1) AS x")
    a, b = dealt(jobs), dealt(jobs.where("job_id < '3'"))
    assert dealt(a) is a
    key = lambda df, n: df.select("job_id", F.explode("x").alias("k"), F.lit(n).alias(f"n{n}"))
    with by_shuffle(spark):
        both = key(a, 1).join(key(b, 2), ["job_id", "k"], "left").groupBy("job_id", "k").agg(F.count("n2").alias("n"))
        assert shuffles(both) == 0
    assert both.agg(F.sum("n"), F.count("*")).collect() == [(2 * b.count(), 100)]


def test_records_are_made_and_delivered_in_place(spark, written):
    assert records.delivery_rules(spark, SF).count() > 0
    assert max(n for frames in written for n in frames) == 0


def test_mapping_rules_meet_in_place(spark, written):
    assert records.mapping_rules(spark, SF).count() > 0
    assert sum(n == 0 for n in written[-1]) >= 20, written[-1]
