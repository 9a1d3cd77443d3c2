"""Digest trees, what they say about changes, and the keys of results."""

import random

from refscope.operators import incremental
from refscope.operators.snapshot import changed_folders, snapshot, snapshot_diff, source_digest

SCHEMA = "solution string, file_path string, text string"


def state(spark, files):
    return snapshot(spark.createDataFrame([(s, p, t) for (s, p), t in files.items()], SCHEMA))


def plain_diff(old, new):
    out = {(*k, "removed") for k in old.keys() - new.keys()} | {(*k, "added") for k in new.keys() - old.keys()}
    return out | {(*k, "changed") for k in old.keys() & new.keys() if old[k] != new[k]}


def test_random_snapshots_against_plain_comparison(spark):
    rng = random.Random(2)
    names = ["a", "b", "c.cs", "d é.cs"]
    old = {}
    for _ in range(300):
        old["s%d" % rng.randrange(4), "/".join(rng.choice(names) for _ in range(rng.randint(1, 5)))] = rng.choice([None, "", "x", "y"])
    new = dict(old)
    for key in rng.sample(sorted(old), 12):
        new.pop(key)
    for key in rng.sample(sorted(new), 12):
        new[key] = "z"
    new |= {("s1", "a/new.cs"): "n", ("s9", "b.cs"): "n", ("s2", "/rooted/f.cs"): "n"}
    got = snapshot_diff(state(spark, old), state(spark, new))
    assert {tuple(r) for r in got.collect()} == plain_diff(old, new) and got.count() == len(plain_diff(old, new))


def test_equal_and_empty_snapshots(spark):
    files = {("s", "a/b/c.cs"): "x", ("s", "d.cs"): None}
    assert snapshot_diff(state(spark, files), state(spark, files)).count() == 0
    nothing = snapshot(spark.createDataFrame([], SCHEMA))
    assert snapshot_diff(nothing, nothing).count() == 0
    assert {tuple(r) for r in snapshot_diff(nothing, state(spark, files)).collect()} == {("s", "a/b/c.cs", "added"), ("s", "d.cs", "added")}
    assert {r.change for r in snapshot_diff(state(spark, files), nothing).collect()} == {"removed"}


def test_only_changed_branches_are_looked_into(spark, plans):
    old = {("s", f"{top}/{mid}/{i}.cs"): "x" for top in "ab" for mid in "cd" for i in range(5)}
    new = old | {("s", "a/c/3.cs"): "y", ("s", "b/e.cs"): "z"}
    before, after = state(spark, old), state(spark, new)
    plans.clear()
    found = changed_folders(before, after)
    assert {tuple(r) for r in found.collect()} == {("s", "a/c"), ("s", "b")}
    # Solution, its two folders, the one folder below them that differs, and nothing below that.
    assert [label for label, _ in plans].count("changed-folders") == 4
    twice = spark.createDataFrame([("s", "a", "x"), ("s", "a", "x")], SCHEMA)
    assert {tuple(r) for r in snapshot_diff(snapshot(twice.limit(1)), snapshot(twice)).collect()} == {("s", "a", "changed")}


def test_a_key_follows_removal_renaming_and_restoring(spark):
    jobs = spark.createDataFrame([("j", "s", "P", "1", False)], "job_id string, solution string, package string, version string, force_refresh boolean")

    def key(files):
        rows = spark.createDataFrame(files, "solution string, file_path string, mtime string, text string")
        found = incremental.source_state(rows.withColumn("mtime", rows.mtime.cast("timestamp")))
        return incremental.fingerprint(jobs, found).first().fingerprint

    a, b = ("s", "a.cs", "2024-01-01", "a"), ("s", "b.cs", "2024-02-01", "b")
    keys = [
        key([a, b]),
        key([b]),
        key([("s", "c.cs", *a[2:]), b]),
        key([("s", "a.cs", "2023-01-01", "a"), b]),
        key([("s", "a.cs", "2024-01-01", "other"), b]),
    ]
    assert len(set(keys)) == 5 and key([b, a]) == keys[0]


def test_the_digest_of_a_snapshot_is_part_of_a_key(spark):
    one, two = {("s", "a/b.cs"): "x", ("s", "c.cs"): "y"}, {("s", "a/b.cs"): "x"}
    jobs = spark.createDataFrame([("j", "s", "P", "1")], "job_id string, solution string, package string, version string")
    keys = set()
    for files in (one, two):
        found = source_digest(state(spark, files)).selectExpr("*", "timestamp'2024-01-01' AS mtime")
        assert found.first().files == len(files)
        keys.add(incremental.fingerprint(jobs, found).first().fingerprint)
    assert len(keys) == 2 and None not in keys
