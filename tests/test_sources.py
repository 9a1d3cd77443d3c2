"""Files, job lists, package folders and stored results."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from refscope.operators import reports
from refscope.schemas import USAGE_SCHEMA
from refscope.sources import files, jobs, packages, results


def test_read_source_files(spark, write_files):
    root = write_files({"App/a b.cs": "one\r\ntwo", "App/x.PNG": b"\x89PNG", "Lib/sub/c+d.cs": b"\xef\xbb\xbfthree\n", "top.cs": "x", "none.cs": "", "bad.cs": b"\xff\xfe\xfa"})
    found = files.read_source_files(spark, root, "sln")
    rows = {r["file_path"]: (r["project_name"], r["text"]) for r in found.collect()}
    assert rows == {
        "App/a b.cs": ("App", "one\r\ntwo"), "Lib/sub/c+d.cs": ("Lib", "three\n"), "top.cs": ("", "x"), "bad.cs": ("", None),
        **({"none.cs": ("", "")} if "none.cs" in rows else {}),
    }
    errors = files.unreadable_files(found).collect()
    assert [tuple(r) for r in errors] == [("sln", "", "Cannot read file: bad.cs")]
    found = found.where("file_path NOT IN ('bad.cs', 'none.cs')")
    assert found.where("mtime IS NULL").count() == 0
    lines = files.explode_lines(found).collect()
    assert sorted((r["file_path"], r["line_no"], r["line"]) for r in lines) == [
        ("App/a b.cs", 1, "one"),
        ("App/a b.cs", 2, "two"),
        ("Lib/sub/c+d.cs", 1, "three"),
        ("Lib/sub/c+d.cs", 2, ""),
        ("top.cs", 1, "x"),
    ]
    assert {tuple(r) for r in files.project_inventory(found).collect()} == {("sln", "", 1), ("sln", "App", 1), ("sln", "Lib", 1)}


def test_read_jobs(spark, write_files):
    root = write_files(
        {
            "lower.json": '{"jobs": [\n {"solutionPath": "a.sln", "packageName": "P", "packageVersion": "1", "forceRefresh": true}]}',
            "upper.json": '{"Jobs": [{"SolutionPath": "b.sln", "PackageName": "Q", "PackageVersion": "2"}]}',
            "shout.json": '{"JOBS": [{"SOLUTIONPATH": "c.sln", "PACKAGENAME": "R", "PACKAGEVERSION": "3"}]}',
            "empty.json": "{}",
            "null.json": '{"jobs": null}',
        }
    )
    found = jobs.with_job_ids(jobs.read_jobs(spark, root)).collect()
    assert {tuple(r) for r in found} == {("a.sln", "P", "1", True, "a.sln|P|1"), ("b.sln", "Q", "2", False, "b.sln|Q|2"), ("c.sln", "R", "3", False, "c.sln|R|3")}


@pytest.mark.parametrize(
    "text",
    ["null", "not json", "[]", '{"jobs": {}}', '{"JOBS": "x"}', '{"jobs": [1]}', '{"jobs": [{"solutionPath": "a.sln", "packageName": "P"}]}'],
)
def test_bad_job_lists_fail(spark, text):
    with pytest.raises(Exception, match="batch configuration|job without"):
        jobs.parse_jobs(spark.createDataFrame([(text,)], "value string")).collect()


def test_package_folder(spark, write_files):
    root = write_files({"acme/1.0/lib/net6.0/Acme.dll": "x", "acme/1.0/lib/net6.0/Acme.xml": "x", "acme/1.0/ref/Acme.Ref.dll": "x"})
    found = packages.assemblies_from_listing(packages.read_package_files(spark, root)).collect()
    assert [tuple(r) for r in found] == [("acme", "1.0", "acme")]
    # The same folder with its archive beside it counts ``ref`` items as well.
    write_files({"acme/1.0/acme.1.0.NUPKG": "x", "lone/2.0/ref/net6.0/Lone.dll": "x"})
    found = packages.assemblies_from_listing(packages.read_package_files(spark, root)).collect()
    assert sorted(tuple(r) for r in found) == [("acme", "1.0", "acme"), ("acme", "1.0", "acme.ref")]


def test_declared_versions(spark):
    manifest = '<PackageReference Include="A" Version="1" /><PackageReference Version="2"\n Include="A" /><PackageReference Include="B"/>'
    rows = spark.createDataFrame([("s", "p", manifest), ("s", "q", None)], "solution string, project_name string, text string")
    found = sorted(tuple(r) for r in packages.declared_packages(rows).collect())
    assert found == [("s", "p", "A", "1"), ("s", "p", "A", "2"), ("s", "p", "B", "")]


def test_declared_packages(spark):
    manifest = '<PackageReference Include="Polly" Version="7.2.3" />\n<PackageReference\n  Include="A.B" />\n<ProjectReference Include="c" />'
    rows = spark.createDataFrame([("p", manifest)], "project_name string, text string")
    assert sorted(r["package"] for r in packages.package_references(rows).collect()) == ["A.B", "Polly"]


def usage(job, line):
    return (job, "s", "p", "f", line, line, "x", "Direct", "S", None, None, 0, 0, False)


def test_results_are_replaced_loaded_and_forgotten(spark, tmp_path):
    root = str(tmp_path / "store")
    keys = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", None), ("d", "f4")], "job_id string, fingerprint string")

    def stored():
        return {(r["fingerprint"], r["usage_count"]) for r in results.stored_headers(spark, root).collect()}

    def load():
        return sorted((r["job_id"], r["start_line"]) for r in results.load_results(spark, root, keys).collect())

    assert stored() == set() and load() == []
    rows = [usage("a", 1), usage("a", 2), usage("b", 1), usage("c", 1)]
    results.save_results(keys, spark.createDataFrame(rows, USAGE_SCHEMA), root)
    assert stored() == {("f1", 2), ("f2", 1), ("f4", 0)}  # no key, no store; no usage is a result too
    assert load() == [("a", 1), ("a", 2), ("b", 1)]
    only_a = keys.where("job_id = 'a'")
    results.save_results(only_a, spark.createDataFrame([usage("a", 9)], USAGE_SCHEMA), root)
    assert stored() == {("f1", 1), ("f2", 1), ("f4", 0)}
    assert load() == [("a", 9), ("b", 1)]
    renamed = only_a.selectExpr("'other' AS job_id", "fingerprint")
    assert [r["job_id"] for r in results.load_results(spark, root, renamed).collect()] == ["other"]
    results.invalidate(spark, root, only_a)
    results.invalidate(spark, root, only_a)
    assert stored() == {("f2", 1), ("f4", 0)}
    assert load() == [("b", 1)]
    results.compact(spark, root)
    assert stored() == {("f2", 1), ("f4", 0)} and load() == [("b", 1)]
    assert len(os.listdir(f"{root}/usages")) == len(os.listdir(f"{root}/headers")) == 1
    left = spark.read.parquet(f"{root}/usages")
    assert [r["start_line"] for r in left.collect()] == [1]
    results.save_results(only_a, spark.createDataFrame([usage("a", 4)], USAGE_SCHEMA), root)
    assert load() == [("a", 4), ("b", 1)]


def test_sketches_of_any_union_of_results(spark, tmp_path):
    root = str(tmp_path / "store")
    keys = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("none", "f3"), ("later", "f4")], "job_id string, fingerprint string")
    assert results.load_sketches(spark, root, keys).collect() == []
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, 'a', 'b') AS job_id", "cast(id div 2 AS string) AS file_path", "id")
    blank = spark.createDataFrame([], USAGE_SCHEMA)
    found = blank.unionByName(rows.selectExpr("*", "concat('p', id % 7) AS project_name", "cast(NULL AS string) AS symbol_name").drop("id"), allowMissingColumns=True)
    results.save_results(keys.where("job_id <> 'later'"), found, root)
    results.save_results(keys.where("job_id = 'b'"), found.where("job_id = 'b' AND project_name = 'p1'"), root)

    def spread(jobs):
        merged = reports.merged_spread(results.load_sketches(spark, root, keys.where(jobs)).withColumn("all", F.lit(1)), "all")
        return [tuple(r)[1:] for r in merged.collect()]

    exact = {row[0]: row[1:] for row in map(tuple, reports.usage_spread(found.where("job_id = 'a' OR project_name = 'p1'").withColumn("job_id", F.lit("x"))).collect())}["x"]
    (near,) = spread("true")
    assert near[0] == exact[0] and near[2:] == exact[2:] == (7, 0) and abs(near[1] - exact[1]) <= 0.08 * exact[1]
    assert spread("job_id = 'none'") == [(0, 0, 0, 0)] and spread("job_id = 'later'") == []
    results.compact(spark, root)
    assert spread("true") == [near] and len(os.listdir(f"{root}/sketches")) == 1
    # The usages themselves are not needed; a generation without sketches is an error.
    plan = results.load_sketches(spark, root, keys)._jdf.queryExecution().executedPlan().toString()
    assert "sketches" in plan and "usages/generation" not in plan
    shutil.move(glob.glob(f"{root}/sketches/generation=*")[0], str(tmp_path / "elsewhere"))
    with pytest.raises(ValueError, match="compact"):
        results.load_sketches(spark, root, keys)


def test_only_wanted_generations_are_read(spark, tmp_path):
    root = str(tmp_path / "store")
    for job in ("a", "b", "c"):
        keys = spark.createDataFrame([(job, f"f{job}")], "job_id string, fingerprint string")
        results.save_results(keys, spark.createDataFrame([usage(job, 1)], USAGE_SCHEMA), root)
    asked = spark.createDataFrame([("b", "fb")], "job_id string, fingerprint string")
    found = results.load_results(spark, root, asked)
    assert [r["job_id"] for r in found.collect()] == ["b"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("usages/generation=") <= 1 and "fingerprint" in plan.split("PushedFilters")[1]


def test_an_empty_store(spark, tmp_path):
    root = str(tmp_path / "nowhere")
    keys = spark.createDataFrame([("a", "f1")], "job_id string, fingerprint string")
    assert results.stored_headers(spark, root).count() == 0 and results.load_results(spark, root, keys).count() == 0
    results.invalidate(spark, root, keys)
    results.compact(spark, root)
    assert results.load_results(spark, root, keys).count() == 0


def test_damaged_result_is_a_miss(spark, tmp_path):
    root = str(tmp_path / "store")
    keys = spark.createDataFrame([("a", "f1")], "job_id string, fingerprint string")
    results.save_results(keys, spark.createDataFrame([usage("a", 1)], USAGE_SCHEMA), root)
    for path in glob.glob(f"{root}/usages/generation=*"):
        shutil.move(path, os.path.join(str(tmp_path), "elsewhere"))
    os.makedirs(f"{root}/usages", exist_ok=True)
    assert results.stored_headers(spark, root).count() == 0
