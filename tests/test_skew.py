"""Joins on a key that any number of rows share: the rows are not moved to that key's task."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from psephos.operators import grouping, ranking


@pytest.fixture(autouse=True)
def nothing_is_known_to_be_small(spark):
    """Tables are larger than what Spark broadcasts by itself."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d12_overvoted", "d9_contest_status", "b11_view_filters", "d13_counters", "d14_tally_by_batch", "a8_cvr_lines", "a9_cvr_texts", "d13_tally_precinct_mode"])
def test_votes_are_not_dealt_out_by_contest(spark, sf, name):
    """There are three contests: a shuffle by contest alone is three tasks."""
    text = plan(__spark_entry__.queries()[name](spark, sf))
    assert not [line for line in text.splitlines() if "Exchange hashpartitioning(cid#" in line and line.split("hashpartitioning(")[1].count("#") == 1]


def test_members_are_not_dealt_out_by_partition(spark):
    tags = spark.range(500).select("id", F.when(F.col("id") < 450, "same").otherwise(F.col("id").cast("string")).alias("tag"))
    dense = ranking.dense_ids(tags, ["tag"], "n")
    assert "SortMergeJoin" not in plan(dense) and sorted((r.tag, r.n) for r in dense.distinct().collect() if r.id == 0) == [("same", 50)] and dense.count() == 500
    spread = grouping.spread(dense.groupBy("n").agg(F.min("tag").alias("v")), dense.select("id", "n"), "n")
    assert "SortMergeJoin" not in plan(spread) and spread.where("v = 'same'").count() == 450


def test_many_keys_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW", 3)
    tags = spark.range(50).select("id", (F.col("id") % 10).cast("string").alias("tag"))
    dense = ranking.dense_ids(tags, ["tag"], "n")
    assert sorted({(r.tag, r.n) for r in dense.collect()}) == [(str(k), k) for k in range(10)]


def test_lines_are_dealt_by_their_number(spark, sf, monkeypatch):
    """Six lines and a target of each line item are dealt into parts by their number, not by the size of the table they are made from; the boxes are the same."""
    from psephos.operators import boxes
    from psephos.plans.queries import QUERIES

    rows = lambda: QUERIES["o16_extracted_contests"](spark, sf)
    want = sorted(map(tuple, rows().collect()))
    monkeypatch.setattr(boxes, "ROWS", 1000)
    parts = -(-7 * spark.read.parquet(f"{sf}/lineitem.parquet").count() // 1000)
    assert rows().rdd.getNumPartitions() == parts and sorted(map(tuple, rows().collect())) == want
