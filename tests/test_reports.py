"""Summaries, merging, batch outcome and JSON documents."""

import json

import pytest
from pyspark.sql import functions as F

from refscope.operators import audit, incremental, reports
from refscope.config import SHIPPED_SIMILARITY, AnalysisOptions
from refscope.schemas import USAGE_SCHEMA


def usages(spark, n=7):
    rows = [("j", "s", f"p{i % 2}", 'a"b\\c', i, i, "code\n\tüx", "MethodInvocation", "S", None, "L", 1, 2, True) for i in range(n)]
    return spark.createDataFrame(rows, USAGE_SCHEMA)


def parts(spark):
    jobs = spark.createDataFrame(
        [("j", "s", "P", "1"), ("k", "s", "Q", "2")], "job_id string, solution string, package string, version string"
    ).select("*", F.to_timestamp(F.lit("2024-01-02 03:04:05.678901")).alias("analyzed_at"), F.lit(90061001).cast("bigint").alias("duration_ms"))
    projects = spark.createDataFrame([("j", "p0"), ("j", "p1"), ("j", "p1"), ("k", "p9")], "job_id string, project_name string")
    errors = spark.createDataFrame([("j", 'Project p1: "bad"')], "job_id string, error string")
    return jobs, projects, errors


def test_summary_and_duration(spark):
    jobs, projects, errors = parts(spark)
    out = reports.summary(jobs, usages(spark), projects, errors)
    out = out.withColumn("d", reports.duration_text(F.col("duration_ms")))
    found = {r["job_id"]: (r["total_usage_count"], r["analyzed_project_count"], r["error_count"], r["d"]) for r in out.collect()}
    assert found == {"j": (7, 2, 1, "01:01:01.001"), "k": (0, 1, 0, "01:01:01.001")}


def read(report):
    """A job's parts in reading order: (part, parsed json)."""
    out = {}
    for r in sorted(report.collect(), key=lambda r: (r["job_id"], r["part"], r["position"], r["json"])):
        out.setdefault(r["job_id"], []).append((reports.PARTS[r["part"]], json.loads(r["json"])))
    return out


@pytest.mark.parametrize("n", [7, 400])
def test_report_parts_hold_everything(spark, n):
    jobs, projects, errors = parts(spark)
    head = reports.summary(jobs, usages(spark, n), projects, errors)
    found = read(reports.usage_report(head, usages(spark, n), projects, errors))
    assert found["j"][0] == ("summary", {
        "solutionPath": "s", "packageName": "P", "packageVersion": "1", "analyzedAt": "2024-01-02T03:04:05.678901Z",
        "analysisDuration": "01:01:01.001", "totalUsageCount": n, "analyzedProjectCount": 2, "errorCount": 1,
    })
    listed = [x for part, x in found["j"] if part == "usage"]
    assert sorted(u["startLine"] for u in listed) == list(range(n))
    assert [(u["projectName"], u["startLine"]) for u in listed] == sorted((u["projectName"], u["startLine"]) for u in listed)
    assert listed[0] == {
        "projectName": "p0", "filePath": 'a"b\\c', "startLine": 0, "endLine": 0, "codeText": "code\n\tüx",
        "usageType": "methodInvocation", "symbolName": "S", "namespace": None, "assemblyName": "L",
    }
    assert [x for part, x in found["j"] if part == "project"] == ["p0", "p1"]
    assert [x for part, x in found["j"] if part == "error"] == ['Project p1: "bad"']
    assert [part for part, _ in found["k"]] == ["summary", "project"]


def test_a_report_is_stored_in_reading_order(spark, tmp_path):
    jobs, projects, errors = parts(spark)
    report = reports.usage_report(reports.summary(jobs, usages(spark), projects, errors), usages(spark), projects, errors)
    reports.write_report(report, str(tmp_path / "r"))
    rows = [tuple(r) for p in sorted(tmp_path.glob("r/part-*")) for r in spark.read.parquet(str(p)).collect()]
    assert rows == sorted(rows) and len(rows) == report.count()


@pytest.mark.parametrize("pascal", [False, True])
def test_one_document_per_job(spark, tmp_path, pascal):
    jobs, projects, errors = parts(spark)
    found = usages(spark, 300).unionByName(usages(spark, 3))
    build = reports.full_result if pascal else reports.usage_report
    report = build(reports.summary(jobs, found, projects, errors), found, projects, errors)
    stray = report.where("part = 2").limit(1).withColumn("job_id", F.lit("headless"))
    # Small ranges are not put together here, so a job crosses files.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.write_documents(reports.documents(report.unionByName(stray), pascal), str(tmp_path / "d"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(p.name for p in tmp_path.glob("d/job_id=*")) == ["job_id=j", "job_id=k"]
    assert len(list(tmp_path.glob("d/job_id=j/part-*"))) > 1
    read_parts = read(report)
    for job in "jk":
        text = "".join(p.read_text() for p in sorted(tmp_path.glob(f"d/job_id={job}/part-*")))
        document = json.loads(text)
        of = {part: [x for kind, x in read_parts[job] if kind == part] for part in reports.PARTS}
        names = ["AnalyzedProjects", "Usages", "Errors"] if pascal else ["analyzedProjects", "usages", "errors"]
        head = of["summary"][0] if pascal else {"summary": of["summary"][0]}
        assert document == head | dict(zip(names, (of["project"], of["usage"], of["error"])))
    assert len(found.collect()) == 303 and document["Usages" if pascal else "usages"] == []


def test_no_documents_without_jobs(spark):
    empty = spark.createDataFrame([], "job_id string, part int, position string, json string")
    assert reports.documents(empty).collect() == []


def test_full_result(spark):
    jobs, projects, errors = parts(spark)
    head = reports.summary(jobs, usages(spark, 1), projects, errors)
    found = read(reports.full_result(head, usages(spark, 1), projects, errors))
    assert list(found["j"][0][1]) == ["SolutionPath", "PackageName", "PackageVersion", "AnalyzedAt", "AnalysisDuration", "TotalUsageCount"]
    usage = next(x for part, x in found["j"] if part == "usage")
    assert (usage["Type"], usage["ContextStartLine"], usage["HasContext"]) == ("MethodInvocation", 1, True)
    symbols = head.drop("package", "version").withColumn("target", F.lit("A.B"))
    named = read(reports.full_result(symbols, usages(spark, 1), projects, errors, symbol=True))["j"][0][1]
    assert (named["PackageName"], named["PackageVersion"]) == ("symbol:A.B", "N/A")


def test_failed_project_does_not_stop_the_rest(spark):
    good = usages(spark, 2).withColumn("error", F.lit(None).cast("string"))
    bad = spark.createDataFrame([("j", "p7", "boom")], "job_id string, project_name string, error string")
    merged, projects, errors = reports.merge_results([good, bad])
    assert merged.count() == 2
    assert sorted(r["project_name"] for r in projects.collect()) == ["p0", "p1", "p7"]
    assert [tuple(r) for r in errors.collect()] == [("j", "Project p7: boom")]


def test_batch_outcome(spark):
    jobs, _, errors = parts(spark)
    rows = reports.batch_results(jobs, usages(spark), errors.where(F.lit(False)))
    assert {r["job_id"]: (r["success"], r["usage_count"]) for r in rows.collect()} == {"j": (True, 7), "k": (True, 0)}
    failed = reports.batch_results(jobs, usages(spark), errors)
    assert tuple(reports.batch_outcome(failed).first()) == (2, 1, 1, 0)


def test_detailed_order(spark):
    rows = reports.detailed_report(usages(spark)).collect()
    assert [(r["project_name"], r["start_line"]) for r in rows] == sorted((r["project_name"], r["start_line"]) for r in rows)


def test_fingerprint(spark):
    import hashlib

    jobs, _, _ = parts(spark)
    state = spark.sql("SELECT 's' AS solution, timestamp'2024-05-06 07:08:09.123456' AS mtime")

    def keys(**options):
        out = incremental.fingerprint(jobs, state, AnalysisOptions(**options))
        return {r["job_id"]: r["fingerprint"] for r in out.collect()}

    text = "s|P|1|2024-05-06T07:08:09.1234560Z|context:0"
    assert keys()["j"] == hashlib.sha256(text.encode()).hexdigest()
    different = [keys(), keys(context_lines=1), keys(usage_types=["Direct"]), keys(similarity=SHIPPED_SIMILARITY), keys(strict_paths=True)]
    assert len({k["j"] for k in different}) == 5
    assert keys(usage_types=["Direct", "attribute"]) == keys(configured_usage_types=["Attribute", "direct", "bad"])
    unknown = incremental.fingerprint(jobs, state.where(F.lit(False))).collect()
    assert {r["fingerprint"] for r in unknown} == {None}


def test_time_zones_change_neither_key_nor_report(spark):
    jobs, projects, errors = parts(spark)
    state = spark.sql("SELECT 's' AS solution, timestamp'2024-05-06 07:08:09.123 UTC' AS mtime")
    plain = state.withColumn("mtime", F.to_timestamp_ntz(F.lit("2024-05-06 07:08:09.123")))
    head = reports.summary(jobs, usages(spark), projects, errors)

    def seen():
        keys = [incremental.fingerprint(jobs, s).where("job_id = 'j'").first()["fingerprint"] for s in (state, plain)]
        return keys, head.select("job_id", "analyzed_at").count(), read(reports.usage_report(head, usages(spark), projects, errors))["j"][0]

    here = seen()
    assert here[0][0] == here[0][1]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert incremental.fingerprint(jobs, state).where("job_id = 'j'").first()["fingerprint"] == here[0][0]
        assert incremental.fingerprint(jobs, plain).where("job_id = 'j'").first()["fingerprint"] == here[0][0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_resolved_assemblies_are_part_of_the_key(spark):
    jobs, _, _ = parts(spark)
    state = spark.sql("SELECT 's' AS solution, timestamp'2024-05-06' AS mtime")

    def key(*names):
        table = spark.createDataFrame([("j", n) for n in names], "job_id string, assembly_lc string")
        return incremental.fingerprint(jobs, state, AnalysisOptions(), table).where("job_id = 'j'").first()["fingerprint"]

    assert key("a", "b") == key("b", "a", "a") and len({key("a"), key("a", "b"), key("c")}) == 3


def test_split_jobs(spark):
    jobs = spark.createDataFrame(
        [("a", "f1", False), ("b", "f1", True), ("c", "f2", False), ("d", None, False)],
        "job_id string, fingerprint string, force_refresh boolean",
    )
    run, reuse = incremental.split_jobs(jobs, spark.createDataFrame([("f1",), (None,)], "fingerprint string"))
    assert sorted(r["job_id"] for r in run.collect()) == ["b", "c", "d"]
    assert [r["job_id"] for r in reuse.collect()] == ["a"]


def test_changed_files(spark):
    schema = "solution string, file_path string, mtime int"
    now = spark.createDataFrame([("s", "same", 5), ("s", "newer", 6), ("s", "new", 1), ("s", "older", 4)], schema)
    old = spark.createDataFrame([("s", "same", 5), ("s", "newer", 5), ("s", "older", 5), ("s", "gone", 5)], schema)
    assert sorted(r["file_path"] for r in incremental.changed_files(now, old).collect()) == ["new", "newer"]


MANIFESTS = [
    ("a/App.csproj", 'x\n  <UsingTask A/>\n<UsingTask B/>\n<Exec Command="x"/>\n<Executable/>'),
    ("a/Gen.csproj", '<PackageReference Include="My.Analyzers" OutputItemType="Analyzer"/>\n<projectreference include="sourcegenerator.csproj"/>'),
    ("a/b.props", '<PackageReference Include="Tools"><IncludeAssets>analyzers</IncludeAssets>'),
    ("a/App.CSPROJ", "UsingTask"),
    ("a/t.tt", "UsingTask"),
    ("a/INSTALL.ps1", ""),
    ("a/myinstall.ps1", ""),
]


def test_manifest_rules(spark):
    found = audit.rule_scan(spark.createDataFrame(MANIFESTS, "file_path string, text string")).collect()
    assert sorted((r["file_path"], r["check"], r["detail"]) for r in found) == sorted(
        [
            ("a/App.csproj", "UsingTask", "defines or references a custom MSBuild task"),
            ("a/App.csproj", "Exec", "runs an <Exec> command as part of the build"),
            ("a/Gen.csproj", "Analyzer/SourceGenerator", '1:<PackageReference Include="My.Analyzers" OutputItemType="Analyzer"/>'),
            ("a/Gen.csproj", "Analyzer/SourceGenerator", '1:<PackageReference Include="My.Analyzers" OutputItemType="Analyzer"/>'),
            ("a/Gen.csproj", "Analyzer/SourceGenerator", '2:<projectreference include="sourcegenerator.csproj"/>'),
            ("a/t.tt", "T4", "T4 template file present"),
            ("a/INSTALL.ps1", "InstallScript", "NuGet install/init PowerShell script present"),
        ]
    )


def test_scan_summary(spark):
    files = spark.createDataFrame(MANIFESTS, "file_path string, text string")
    assert tuple(audit.scan_summary(files, audit.rule_scan(files)).first()) == (3, 1, 1, 7, False)
    clean = files.where("file_path = 'a/b.props'")
    assert tuple(audit.scan_summary(clean, audit.rule_scan(clean)).first()) == (1, 0, 0, 0, True)
    none = files.where("file_path = 'a/t.tt'")
    with pytest.raises(Exception, match="no manifest found"):
        audit.scan_summary(none, audit.rule_scan(none)).collect()


def test_expectations(spark):
    expected = spark.createDataFrame([("a", 1, 3), ("b", 1, 3), ("c", 0, 0), ("d", 1, 1)], "check_name string, lo int, hi int")
    counts = spark.createDataFrame([("a", 3, 0), ("b", 4, 0), ("d", 1, 2)], "check_name string, n long, errors long")
    found = {r["check_name"]: r["passed"] for r in audit.check_expectations(expected, counts).collect()}
    assert found == {"a": True, "b": False, "c": True, "d": False}


def test_unused_packages(spark):
    declared = spark.createDataFrame([("p", "Polly"), ("p", "Used")], "project_name string, package string")
    used = spark.createDataFrame([("p", "Used"), ("q", "Polly")], "project_name string, package string")
    assert [r["package"] for r in audit.unused_packages(declared, used, ["project_name", "package"]).collect()] == ["Polly"]
