"""Usages that follow changes of files against full runs."""

import random

import pytest

from refscope import runtime
from refscope.plans.analyze import Tables, analyze_changes, analyze_package
from refscope.schemas import USAGE_COLUMNS
from refscope.sources import changes

REF = (
    "solution string, project_name string, file_path string, start_line int, end_line int, node_kind string, parent_kind string,"
    " symbol_kind string, symbol_name string, namespace string, display_name string, assembly_name string, code_text string"
)


def rows_of(files):
    out = []
    for (solution, path), (text, refs) in files.items():
        out += [(solution, f"p{len(path) % 2}", path, i, i, "MemberAccess", "Other", "Method", "x", "N", "N.x", a, text) for i, a in enumerate(refs)]
    return out


def tables(spark, files, refs=None):
    return Tables(
        refs=spark.createDataFrame(rows_of(files), REF) if refs is None else refs,
        projects=spark.createDataFrame([("s", "p0"), ("s", "p1"), ("t", "p0")], "solution string, project_name string"),
        reference_paths=spark.createDataFrame([], "solution string, path string"),
        package_assemblies=spark.createDataFrame([("a", "1", "a"), ("b", "1", "b")], "package string, version string, assembly_lc string"),
        files=spark.createDataFrame([(s, p, t) for (s, p), (t, _) in files.items()], "solution string, file_path string, text string"),
    )


def jobs_of(spark, *packages):
    rows = [(f"{s}{p}", s, p, "1") for s in "st" for p in packages]
    return spark.createDataFrame(rows, "job_id string, solution string, package string, version string")


def invented(rng):
    return {(rng.choice("st"), f"d{rng.randrange(3)}/f{i}.cs"): (f"v{i}", [rng.choice("abc") for _ in range(rng.randint(0, 4))]) for i in range(30)}


def edited(files, rng, step):
    out = dict(files)
    for key in rng.sample(sorted(out), 4):
        del out[key]
    for key in rng.sample(sorted(out), 4):
        out[key] = (f"{out[key][0]}-{step}", [rng.choice("abc") for _ in range(3)])
    return out | {("s", f"new{step}.cs"): ("n", ["a", "b"]), ("t", f"d1/new{step}.cs"): ("n", [])}


def check(spark, store, jobs, given):
    full = analyze_package(jobs, given).usages.select(*USAGE_COLUMNS)
    assert sorted(map(str, store.usages().collect())) == sorted(map(str, full.collect()))
    want = {tuple(r) for r in full.groupBy("job_id", "solution", "project_name", "usage_type").count().collect()}
    assert {tuple(r) for r in store.counts().collect()} == want
    assert {tuple(r) for r in store.by_project().collect()} == {tuple(r) for r in full.groupBy("job_id", "project_name").count().collect()}
    rollup = full.rollup("job_id", "project_name", "usage_type").count().collect()
    assert {tuple(r) for r in store.rollup().collect() if r.usages} == {tuple(r) for r in rollup if r["count"]}


def test_updates_equal_full_runs(spark, tmp_path):
    rng, root = random.Random(8), str(tmp_path / "store")
    jobs, files = jobs_of(spark, "a", "b"), invented(rng)
    for step in range(2):
        given = tables(spark, files)
        store = analyze_changes(jobs, given, root, f"batch {step}")
        check(spark, store, jobs, given)
        # A batch that comes twice counts once.
        check(spark, analyze_changes(jobs, given, root, f"batch {step}"), jobs, given)
        files = edited(files, rng, step)
    # A file that comes back as it was long ago.
    analyze_changes(jobs, tables(spark, {}), root, "all gone")
    assert changes.ChangeStore(spark, root).usages().count() == changes.ChangeStore(spark, root).counts().count() == 0
    given = tables(spark, files)
    check(spark, analyze_changes(jobs, given, root, "back"), jobs, given)
    with pytest.raises(ValueError, match="other jobs"):
        analyze_changes(jobs_of(spark, "a"), given, root, "another question")


def test_only_changed_files_are_scanned(spark, tmp_path, plans):
    rng, root = random.Random(9), str(tmp_path / "store")
    jobs, files = jobs_of(spark, "a", "b"), invented(rng)

    def stored(files, name):
        path = str(tmp_path / name)
        spark.createDataFrame(rows_of(files), REF).write.parquet(path)
        return spark.read.parquet(path)

    analyze_changes(jobs, tables(spark, files, stored(files, "one")), root, "one")
    key = next(k for k in files if files[k][1])
    files = files | {key: ("edited", ["a"])}
    refs = stored(files, "two")
    given = tables(spark, files, refs)
    plans.clear()
    store = analyze_changes(jobs, given, root, "two")
    scans = [plan for label, plan in plans if label == "fresh-usages"]
    assert len(scans) == 1 and f"EqualTo(file_path,{key[1]})" in scans[0]
    check(spark, store, jobs, given)


def test_an_update_that_died_is_done_anew(spark, tmp_path, monkeypatch):
    root, files = str(tmp_path / "store"), invented(random.Random(10))
    jobs, given = jobs_of(spark, "a"), tables(spark, invented(random.Random(10)))
    real = changes.ChangeStore.counts
    monkeypatch.setattr(changes, "COUNTED", ["job_id", "solution", "project_name", "no_such_column"])
    with pytest.raises(Exception, match="no_such_column"):
        analyze_changes(jobs, given, root, "one")
    monkeypatch.undo()
    assert changes.ChangeStore(spark, root).usages().count() == 0 and real(changes.ChangeStore(spark, root)).count() == 0
    check(spark, analyze_changes(jobs, given, root, "one"), jobs, given)
    assert len(files) > 0


def test_large_updates_move_only_what_meets(spark, tmp_path, plans, monkeypatch):
    """Beyond the broadcast bounds: files are told by marks, usages stay with the tasks that matched them."""
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 5)
    rng, root = random.Random(11), str(tmp_path / "store")
    jobs, files = jobs_of(spark, "a", "b"), invented(rng)
    given = tables(spark, files)
    analyze_changes(jobs, given, root, "one")
    labels = [label for label, _ in plans]
    # The state of the files is written once, to its place in the store.
    assert "file-digests" not in labels and "marks" in labels
    given = tables(spark, edited(files, rng, 0))
    check(spark, analyze_changes(jobs, given, root, "two"), jobs, given)


def test_marks_equal_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 5)
    big = spark.range(2000).selectExpr("if(id % 50 = 0, null, concat('k', id % 300)) k", "id % 7 n", "id v")
    side = spark.range(40).selectExpr("if(id = 0, null, concat('k', id * 11)) k", "id % 7 n", "id s")
    side = runtime.cut(side, "marked-side")
    for how in ("left_semi", "left"):
        found, plain = runtime.marked(big, side, ["k", "n"], how), big.join(side, ["k", "n"], how)
        assert found.columns == plain.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    # Every key has its bit: none of the rows that match is lost, and most others do not move.
    exchanged = [p for p in runtime.marked(big, side, ["k", "n"])._jdf.queryExecution().executedPlan().toString().split("\n") if "getbit" in p]
    assert exchanged
