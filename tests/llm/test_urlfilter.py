import random

import pytest
from pyspark.sql import functions as F

from refscope.llm import urlfilter as U


@pytest.mark.parametrize(("filter_bits", "plan_bits"), [(1 << 22, 1 << 26), (1 << 22, 0), (640, 1 << 26), (640, 0)])
@pytest.mark.parametrize("share", [0.0, 0.05, 0.6, 1.0])
def test_cascade_is_exact_over_its_universe(spark, share, filter_bits, plan_bits):
    rng = random.Random(7)
    rows = [(f"k{i}", rng.random() < share) for i in range(3000)]
    listed = {k for k, x in rows if x}
    rows += [("k1", None), (None, True), ("k2", False)]
    df = spark.createDataFrame(rows, "key string, listed boolean")
    cascade = U.build_cascade(df, "key", "listed", bits_per_key=3, filter_bits=filter_bits, plan_bits=plan_bits)
    assert cascade.in_plan == (plan_bits > 0 or not cascade.sizes)
    assert (cascade.shards > 1) == (filter_bits == 640 and len(listed) * 3 > 640)
    got = cascade.contains(df.withColumn("shard", F.lit("s")), F.col("key"), "inside")
    assert got.columns == ["key", "listed", "shard", "inside"]
    assert all(r.inside == (r.key in listed) for r in got.collect())
    assert got.count() == len(rows)
    if cascade.in_plan:
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_empty_universe(spark):
    df = spark.createDataFrame([], "key string, listed boolean")
    cascade = U.build_cascade(df, "key", "listed")
    assert [r.x for r in cascade.contains(spark.createDataFrame([("a",), (None,)], "key string"), F.col("key"), "x").collect()] == [False, False]


def test_rules_and_parts(spark):
    rules = [
        U.Rule("allow", "org", "/"), U.Rule("block", "example.org", "/es/"), U.Rule("block", "example.org", "/en/1"),
        U.Rule("allow", "com", "/fr/"), U.Rule("block", "com", "/de/"),
    ]
    cases = {
        "https://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://example.org/en/19#t": ("example.org", "/en/19", "example.org/en/1", "block"),
        "x://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "x://com/de/": ("com", "/de/", "com/de/", "block"),
        "x://telecom/de/": ("telecom", "/de/", None, "allow"),
        "x://example.org": ("example.org", "", None, "block"),
        "x://example.org?a/b": ("example.org", "", None, "block"),
        "x://É.com/fr/É": ("É.com", "/fr/É", "com/fr/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "a://b.net/x://c.org/": ("b.net", "/x://c.org/", None, "allow"),
        "a://b.net/two\nlines": ("b.net", "/two\nlines", None, "allow"),
    }
    pages = spark.createDataFrame([*enumerate(cases), (99, None), (99, None), (None, "x://com/de/")], "page_id long, url string")
    pages = pages.withColumn("host", F.lit(1)).withColumn("listed", F.lit(1))
    listed = spark.createDataFrame([("example.org", True), ("b.net/x", False)], "key string, listed boolean")
    host, path = U.split_url(F.col("url"))
    universe = pages.select(F.concat(host, path).alias("key"), F.lit(False).alias("listed")).unionByName(listed)
    got = U.judged(pages, rules, "concat(host, path)", U.build_cascade(universe, "key", "listed")).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert found[99] == ("", "", None, "allow") and found[None][3] == "block" and len(got) == len(cases) + 3


def test_levels_that_do_not_end_raise(spark, monkeypatch):
    """Keys that are still mixed up after the last level are an error, not a wrong answer."""
    keys = spark.range(400).selectExpr("cast(id AS string) AS key", "id % 2 = 0 AS listed")
    monkeypatch.setattr(U, "_MOST_LEVELS", 1)
    with pytest.raises(RuntimeError, match="tell all keys apart"):
        U.build_cascade(keys, "key", "listed", bits_per_key=2)


def test_few_shards_are_many_keys_of_the_join(spark):
    """Rows of two shards do not land in two tasks."""
    rows = spark.range(4000).selectExpr("cast(id AS string) AS key", "id % 2 = 0 AS listed")
    cascade = U.build_cascade(rows, "key", "listed", filter_bits=16_000, plan_bits=0)
    assert cascade.shards == 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = cascade.contains(rows.select("key"), F.col("key"), "x")
        assert found.where("x").count() == 2000
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
