"""Written cuts: known sizes, bounded joins, removal."""

import os

import pytest
from pyspark.sql import functions as F

from refscope import runtime


def jobs_of(spark, run):
    """Number of Spark jobs that ``run`` starts."""
    spark.sparkContext.setJobGroup("counted", "counted")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sizes_are_known_from_writing(spark):
    table = runtime.cut(spark.range(1000, numPartitions=200).selectExpr("id", "repeat('x', 10) AS t"), "sized")
    assert jobs_of(spark, lambda: runtime.fits_broadcast(table)) == 0
    assert runtime._sizes[table] == runtime.Size(1000, 1000 * (2 * 16 + 10))
    assert runtime.fits_broadcast(table, rows=1000) and not runtime.fits_broadcast(table, rows=999)
    assert runtime.fits_broadcast(table, size=42_000) and not runtime.fits_broadcast(table, size=41_999)
    with pytest.raises(ValueError, match="written table"):
        runtime.fits_broadcast(spark.range(1))


def test_a_cut_of_nothing(spark):
    table = runtime.cut(spark.range(0).selectExpr("id", "array(id) AS a"), "nothing")
    assert runtime._sizes[table] == runtime.Size(0, 0) and table.count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_both_ways_of_joining_agree(spark, monkeypatch, how):
    big = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) AS k")  # one key holds a third
    small = spark.range(0, 40).selectExpr("id AS k", "id * 2 AS v")

    def run(limit):
        monkeypatch.setattr(runtime, "BROADCAST_ROWS", limit)
        joined = runtime.join_bounded(big, small, ["k"], how)
        rows = sorted(map(tuple, joined.collect()), key=str)
        return rows, joined._jdf.queryExecution().executedPlan().toString()

    near, far = run(40), run(39)
    assert near[0] == far[0] and len(near[0]) > 0
    assert "BroadcastHashJoin" in near[1] and "SortMergeJoin" in far[1]
    for plan in (near[1], far[1]):
        assert "SinglePartition" not in plan


def test_an_owner_removes_its_tables(spark):
    outer = runtime.cut(spark.range(3), "outer")
    with runtime.released(spark):
        inner = runtime.cut(spark.range(5), "inner")
        path = inner.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and inner.agg(F.sum("id")).first()[0] == 10
    assert not os.path.exists(path) and outer.count() == 3
