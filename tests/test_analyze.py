"""Whole analyses: the order of stages, projects without usages, errors, reuse."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from refscope.config import Comparison, Simplifier, SimilarityConfig, AnalysisOptions
from refscope.functions.text import SIMPLIFIERS
from refscope.plans import analyze
from refscope.plans.analyze import Tables, analyze_batch, analyze_declared, analyze_incremental, analyze_isolated, analyze_package, analyze_symbol
from refscope.sources import results

REF = (
    "solution string, project_name string, file_path string, start_line int, end_line int, node_kind string, parent_kind string,"
    " symbol_kind string, symbol_name string, namespace string, display_name string, assembly_name string, code_text string"
)


def ref(line, node, text, project="p1", assembly="Lib", namespace="N.Sub"):
    return ("s", project, "a.cs", line, line, node, "Other", "Method", "Run", namespace, f"{namespace}.Run", assembly, text)


def tables(spark, rows=None):
    rows = rows or [
        ref(1, "BaseList", "same text here"),
        ref(2, "MemberAccess", "same text here!"),
        ref(3, "MemberAccess", "something else entirely", assembly="LIB"),
        ref(4, "MemberAccess", "another library", assembly="Other", namespace="Z"),
        ref(2, "MemberAccess", "the second project uses it", project="p2"),
    ]
    return Tables(
        refs=spark.createDataFrame(rows, REF),
        projects=spark.createDataFrame([("s", "p1"), ("s", "p2"), ("s", "idle")], "solution string, project_name string"),
        reference_paths=spark.createDataFrame([("s", "/x/packages/lib/1/Lib.dll")], "solution string, path string"),
        package_assemblies=spark.createDataFrame([], "package string, version string, assembly_lc string"),
        files=spark.createDataFrame([("s", "a.cs", "l1\nl2\nl3\nl4")], "solution string, file_path string, text string"),
        project_errors=spark.createDataFrame([("s", "idle", "no compilation")], "solution string, project_name string, error string"),
    )


def package_jobs(spark, *packages):
    rows = [(p, "s", p, "1", False) for p in packages]
    return spark.createDataFrame(rows, "job_id string, solution string, package string, version string, force_refresh boolean")


SIMILAR = SimilarityConfig(True, (), (Comparison(max_distance=3, threshold=0.9),))


def lines(found):
    return sorted((r["project_name"], r["start_line"]) for r in found.usages.collect())


def test_package(spark):
    found = analyze_package(package_jobs(spark, "Lib", "Nothing"), tables(spark))
    assert lines(found) == [("p1", 1), ("p1", 2), ("p1", 3), ("p2", 2)]
    totals = {r["job_id"]: (r["total_usage_count"], r["analyzed_project_count"], r["error_count"]) for r in found.summary().collect()}
    assert totals == {"Lib": (4, 3, 1), "Nothing": (0, 3, 1)}
    assert {r["error"] for r in found.job_errors.collect()} == {"Project idle: no compilation"}


def test_similarity_runs_before_the_type_filter(spark):
    options = AnalysisOptions(similarity=SIMILAR, usage_types=["MethodInvocation"])
    found = analyze_package(package_jobs(spark, "Lib"), tables(spark), options)
    # line 1 is kept by similarity, suppresses line 2 and is then filtered out itself
    assert lines(found) == [("p1", 3), ("p2", 2)]


def test_context_replaces_text_before_similarity(spark):
    options = AnalysisOptions(similarity=SIMILAR, context_lines=1)
    found = analyze_package(package_jobs(spark, "Lib"), tables(spark), options)
    rows = {(r["project_name"], r["start_line"]): (r["code_text"], r["context_start_line"], r["has_context"]) for r in found.usages.collect()}
    # "l1\nl2" and "l2\nl3\nl4" differ by 3 or more edits; "l1\nl2\nl3" is within 3 of the first
    assert rows[("p1", 1)] == ("l1\nl2", 1, True)
    assert ("p2", 2) not in rows


def test_context_per_job(spark):
    jobs = package_jobs(spark, "Lib").selectExpr("*", "2 AS context_lines").unionByName(
        package_jobs(spark, "Other").selectExpr("*", "0 AS context_lines")
    )
    found = {(r["job_id"], r["start_line"]): r["code_text"] for r in analyze_package(jobs, tables(spark)).usages.where("project_name = 'p1'").collect()}
    assert found[("Lib", 1)] == "l1\nl2\nl3" and found[("Other", 4)] == "another library"


def test_symbol(spark):
    jobs = spark.createDataFrame([("n", "s", "n"), ("z", "s", "Z.Run"), ("t", "other", "N")], "job_id string, solution string, target string")
    found = analyze_symbol(jobs, tables(spark))
    totals = {r["job_id"]: (r["total_usage_count"], r["analyzed_project_count"]) for r in found.summary().collect()}
    assert totals == {"n": (4, 3), "z": (1, 3), "t": (0, 0)}


def test_missing_inputs_raise(spark):
    whole = tables(spark)
    with pytest.raises(ValueError):
        analyze_package(package_jobs(spark, "Lib"), Tables(whole.refs, whole.projects))
    with pytest.raises(ValueError):
        analyze_symbol(
            spark.createDataFrame([("n", "s", "N")], "job_id string, solution string, target string"),
            Tables(whole.refs, whole.projects),
            AnalysisOptions(context_lines=1),
        )


def test_batch(spark):
    jobs = package_jobs(spark, "Lib", "Nothing").unionByName(package_jobs(spark, "Far").selectExpr("job_id", "'far' AS solution", "package", "version", "force_refresh"))
    rows, totals = analyze_batch(jobs, tables(spark), AnalysisOptions(context_lines=3))
    found = {r["job_id"]: (r["success"], r["error"], r["usage_count"]) for r in rows.collect()}
    assert found == {"Lib": (True, None, 4), "Nothing": (True, None, 0), "Far": (False, "Solution not found: far", None)}
    assert tuple(totals.first()) == (3, 2, 1, 4)


def test_incremental(spark, tmp_path):
    root = str(tmp_path / "store")
    state = spark.sql("SELECT 's' AS solution, timestamp'2024-01-01' AS mtime")
    jobs = package_jobs(spark, "Lib")
    first = analyze_incremental(jobs, tables(spark), state, root)
    assert len(lines(first)) == 4
    changed = tables(spark, [ref(9, "MemberAccess", "new")])
    # same sources as far as the state says: served from the store
    assert len(lines(analyze_incremental(jobs, changed, state, root))) == 4
    # forced, or newer sources, or other settings: computed again
    assert lines(analyze_incremental(jobs, changed, state.selectExpr("solution", "mtime + interval 1 second AS mtime"), root)) == [("p1", 9)]
    assert lines(analyze_incremental(jobs, changed, state, root, AnalysisOptions(usage_types=["MethodInvocation"]))) == [("p1", 9)]
    assert lines(analyze_incremental(jobs.selectExpr("job_id", "solution", "package", "version", "true AS force_refresh"), changed, state, root)) == [("p1", 9)]
    assert lines(analyze_incremental(jobs, changed, state, root)) == [("p1", 9)]


def test_incremental_symbol(spark, tmp_path):
    state = spark.sql("SELECT 's' AS solution, timestamp'2024-01-01' AS mtime")
    jobs = spark.createDataFrame([("n", "s", "N", False)], "job_id string, solution string, target string, force_refresh boolean")
    for _ in range(2):
        assert len(lines(analyze_incremental(jobs, tables(spark), state, str(tmp_path / "store"), symbol=True))) == 4


def test_declared_but_unused(spark):
    text = '<PackageReference Include="Lib" Version="1" /><PackageReference Include="Polly" Version="7.2.3" />'
    rows = [("s", "p1", text), ("s", "idle", text)]
    manifests = spark.createDataFrame(rows, "solution string, project_name string, text string")
    found, unused = analyze_declared(manifests, tables(spark), AnalysisOptions(usage_types=["Inheritance"]))
    assert sorted(tuple(r) for r in unused.collect()) == [
        ("s", "idle", "Lib", "1"), ("s", "idle", "Polly", "7.2.3"), ("s", "p1", "Polly", "7.2.3")
    ]
    assert {r["package"]: r["total_usage_count"] for r in found.summary().collect()} == {"Lib": 4, "Polly": 0}


def test_an_analysis_reports_itself(spark):
    import json

    for found, name in (
        (analyze_package(package_jobs(spark, "Lib"), tables(spark)), "Lib"),
        (analyze_symbol(spark.createDataFrame([("n", "s", "N")], "job_id string, solution string, target string"), tables(spark)), "symbol:N"),
    ):
        head = json.loads(found.result().where("part = 0").first()["json"])
        assert (head["PackageName"], head["TotalUsageCount"]) == (name, 4) and head["AnalyzedAt"].endswith("Z")
        assert found.report().where("part = 2").count() == 4


def test_a_changed_listing_is_computed_again(spark, tmp_path):
    state = spark.sql("SELECT 's' AS solution, timestamp'2024-01-01' AS mtime")
    jobs, root = package_jobs(spark, "Lib"), str(tmp_path / "store")
    before = tables(spark)
    assert len(lines(analyze_incremental(jobs, before, state, root))) == 4
    after = tables(spark)
    after.reference_paths = spark.createDataFrame([("s", "/x/packages/lib/1/Other.dll")], "solution string, path string")
    assert lines(analyze_incremental(jobs, after, state, root)) == [("p1", 4)]


def test_one_text_that_raises_fails_its_job_alone(spark, monkeypatch):
    refuse = lambda text: F.when(text.contains("else"), F.raise_error(F.lit("cannot read this"))).otherwise(text)
    monkeypatch.setitem(SIMPLIFIERS, "Refuse", refuse)
    options = AnalysisOptions(similarity=SimilarityConfig(True, (Simplifier("Refuse"),), SIMILAR.comparisons))
    given = tables(spark, [
        *[ref(i, "MemberAccess", f"{i} is text number {i * 7919}", assembly=f"A{i}") for i in range(9)],
        ref(20, "MemberAccess", "something else", assembly="A4"),
    ])
    given.reference_paths = spark.createDataFrame([("s", f"/x/packages/a{i}/1/A{i}.dll") for i in range(9)], "solution string, path string")
    asked = package_jobs(spark, *[f"A{i}" for i in range(9)], "Nothing")
    unknown = asked.limit(1).selectExpr("'u' job_id", "'gone' solution", "package", "version", "force_refresh")
    with pytest.raises(Exception, match="cannot read this"):
        analyze_batch(asked, given, options)
    rows, totals = analyze_isolated(asked.unionByName(unknown), given, options)
    found = {r["job_id"]: (r["success"], r["error"], r["usage_count"]) for r in rows.collect()}
    assert found.pop("u") == (False, "Solution not found: gone", None)
    success, error, count = found.pop("A4")
    assert (success, count) == (False, None) and "cannot read this" in error
    assert found == {f"A{i}": (True, None, 1) for i in range(9) if i != 4} | {"Nothing": (True, None, 0)}
    assert tuple(totals.first()) == (11, 9, 2, 8)


def test_a_group_of_jobs_reads_its_own_pages(spark, monkeypatch, plans):
    refuse = lambda text: F.when(text.endswith("5"), F.raise_error(F.lit("not five"))).otherwise(text)
    monkeypatch.setitem(SIMPLIFIERS, "Refuse", refuse)
    options = AnalysisOptions(similarity=SimilarityConfig(True, (Simplifier("Refuse"),), SIMILAR.comparisons))
    given = tables(spark, [ref(i, "MemberAccess", f"{i * 7919} is text {i}", assembly=f"A{i}") for i in range(8)])
    given.reference_paths = spark.createDataFrame([("s", f"/x/packages/a{i}/1/A{i}.dll") for i in range(8)], "solution string, path string")
    asked = package_jobs(spark, *[f"A{i}" for i in range(8)])
    groups, real = [], analyze._halving
    watched = lambda run: lambda group: (groups.append(group._jdf.queryExecution().executedPlan().toString()), run(group))[1]
    monkeypatch.setattr(analyze, "_halving", lambda usages, run: real(usages, watched(run)))
    rows, _ = analyze_isolated(asked, given, options)
    assert {r["job_id"] for r in rows.collect() if not r["success"]} == {"A5"}
    halves = [plan for plan in groups if "GreaterThanOrEqual(_hash" in plan and "LessThanOrEqual(_hash" in plan]
    # All jobs, the halves on the way to the one that fails, and all others.
    assert len(groups) == len(halves) + 2 and len(halves) > 1
    stored = [plan for label, plan in plans if label == "usages"]
    assert len(stored) == 1 and "Sort [_hash" in stored[0]


def test_a_plan_that_is_wrong_for_all_jobs_is_raised(spark, monkeypatch):
    monkeypatch.setitem(SIMPLIFIERS, "Refuse", lambda text: F.col("no_such_column"))
    options = AnalysisOptions(similarity=SimilarityConfig(True, (Simplifier("Refuse"),), SIMILAR.comparisons))
    with pytest.raises(AnalysisException):
        analyze_isolated(package_jobs(spark, "Lib"), tables(spark), options)


def test_isolated_equals_batch(spark):
    asked, options = package_jobs(spark, "Lib", "Nothing"), AnalysisOptions(similarity=SIMILAR)
    alone, together = analyze_isolated(asked, tables(spark), options), analyze_batch(asked, tables(spark), options)
    assert [sorted(map(tuple, x.collect())) for x in alone] == [sorted(map(tuple, x.collect())) for x in together]


def test_a_computed_result_is_not_copied_to_be_stored(spark, tmp_path, plans):
    state = spark.sql("SELECT 's' AS solution, timestamp'2024-01-01' AS mtime")
    jobs, root = package_jobs(spark, "Lib", "Nothing"), str(tmp_path / "store")
    fresh = analyze_incremental(jobs, tables(spark), state, root)
    again = analyze_incremental(jobs, tables(spark), state, root)
    assert lines(fresh) == lines(again) and len(lines(again)) == 4
    labels = [label for label, _ in plans]
    # Of the usages of a run only those it computed, and those it read from the store, are written.
    assert labels.count("found") == labels.count("reused") == 2
    assert "generation" not in labels and "all-usages" not in labels
    plans.clear()
    # Usages that are not written yet are computed once.
    results.save_results(jobs.withColumn("fingerprint", F.col("job_id")), fresh.usages.where("start_line > 0"), str(tmp_path / "other"))
    assert [label for label, _ in plans if label == "generation"] == ["generation"]
