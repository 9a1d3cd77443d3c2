"""Matching, filters, and the two ways a bounded join can run."""

import pytest

from refscope import runtime
from refscope.operators import match, resolve
from refscope.sources.packages import assemblies_from_listing

SYMBOL = "id int, namespace string, display_name string"


def matched(spark, rows, targets, **kwargs):
    refs = spark.createDataFrame(rows, SYMBOL)
    wanted = spark.createDataFrame([(f"j{i}", t) for i, t in enumerate(targets)], "job_id string, target string")
    return sorted((r["job_id"], r["id"]) for r in match.match_symbol(refs, wanted, **kwargs).collect())


def test_symbol_rules(spark):
    rows = [
        (1, "System.IO", "System.IO.File"),
        (2, "System.IOx", "System.IOx.File"),
        (3, "system.io.Pipes", "system.io.Pipes.Pipe"),
        (4, "system.io", "system.io.Low"),
        (5, None, "System.IO"),
        (6, None, "Global"),
        (7, "System", "System.Console.WriteLine(string)"),
    ]
    # exact is case-sensitive, below the namespace is not, and a dot ends a name
    assert matched(spark, rows, ["System.IO"]) == [("j0", 1), ("j0", 3), ("j0", 5)]
    assert matched(spark, rows, ["SYSTEM"]) == [("j0", 1), ("j0", 2), ("j0", 3), ("j0", 4)]
    assert matched(spark, rows, ["Global", "System.IO.File"]) == [("j0", 6), ("j1", 1)]
    assert matched(spark, rows, ["System.Console.WriteLine"]) == []
    assert matched(spark, rows, ["System.Console.WriteLine"], match_member=True) == [("j0", 7)]


def test_symbol_matches_once(spark):
    assert matched(spark, [(1, "A", "A")], ["A"]) == [("j0", 1)]


@pytest.mark.parametrize("rows", [500_000, -1])
def test_assembly_ignores_case_and_null(spark, monkeypatch, rows):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", rows)
    refs = spark.createDataFrame(
        [("s", "LIB", 1), ("s", "lib", 2), ("s", None, 3), ("t", "lib", 4), ("s", "other", 5)],
        "solution string, assembly_name string, id int",
    )
    wanted = spark.createDataFrame([("j", "s", "lib"), ("k", "s", "lib")], "job_id string, solution string, assembly_lc string")
    found = sorted((r["job_id"], r["id"]) for r in match.match_assembly(refs, wanted).collect())
    assert found == [("j", 1), ("j", 2), ("k", 1), ("k", 2)]


@pytest.mark.parametrize("limit", [500_000, -1])
def test_null_names_lose_no_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", limit)
    refs = spark.createDataFrame(
        [(1, "A.B", None), (2, None, "A"), (3, None, None), (4, "A", "A.x")], "id int, namespace string, display_name string"
    )
    targets = spark.createDataFrame([("j", "A")], "job_id string, target string")
    assert sorted(r["id"] for r in match.match_symbol(refs, targets).collect()) == [1, 2, 4]


def test_usage_type_names():
    assert match.parse_usage_types(["direct", " ATTRIBUTE ", "nope", "3"]) == ["Direct", "Attribute", "TypeReference"]
    assert match.parse_usage_types(None) == []


def test_usage_type_filter(spark):
    df = spark.createDataFrame([("Direct",), ("Attribute",), ("Inheritance",)], "usage_type string")

    def left(*args):
        return sorted(r["usage_type"] for r in match.filter_usage_types(df, *args).collect())

    everything = ["Attribute", "Direct", "Inheritance"]
    assert left(None, None) == everything
    assert left(None, ["bad"]) == everything
    assert left([], ["Direct"]) == everything  # an explicit empty list is no filter
    assert left(["attribute"], ["Direct"]) == ["Attribute"]
    assert left(None, ["Direct", "bad"]) == ["Direct"]


def test_symbol_name_filter(spark):
    df = spark.createDataFrame([("Guard",), ("GuardClause",), ("guard",)], "symbol_name string")
    assert match.filter_symbol_name(df, contains="Guard").count() == 2
    assert match.filter_symbol_name(df, exact="Guard").count() == 1


def test_paths_hold_names(spark):
    paths = ["/p/packages/newtonsoft.json/13/x.dll", "/p/packages/newtonsoft.json.bson/1/y.dll", "/p/packages/a/b.dll", "/q/n.dll"]
    names = ["newtonsoft.json", "newtonsoft.json.bson", "a", "b.d", "zzz", "newtonsoft.json.schema.long.name"]
    found = resolve.names_inside_paths(
        spark.createDataFrame([(p,) for p in paths], "path_lc string"),
        spark.createDataFrame([(n,) for n in names], "name_lc string"),
    )
    assert {(r["path_lc"], r["name_lc"]) for r in found.collect()} == {(p, n) for p in paths for n in names if n in p}
    assert found.count() == len(found.collect())


def test_tiers(spark):
    jobs = spark.createDataFrame(
        [("s", "X", "1.0"), ("s", "Y", "1.0-RC"), ("s", "Z", "1.0"), ("t", "X", "1.0")],
        "solution string, package string, version string",
    )
    paths = spark.createDataFrame(
        [("s", "C:\\u\\.nuget\\Packages\\x\\1.0\\lib\\X.Core.dll"), ("s", "/u/packages/x.bson/X.Bson.dll"), ("s", "/elsewhere/y/Y.dll")],
        "solution string, path string",
    )
    listing = assemblies_from_listing(
        spark.createDataFrame(
            [
                ("y", "1.0-rc", "lib/net6.0/Y.One.dll"), ("Y", "1.0-RC", "ref/net6.0/Y.Two.DLL"), ("y", "1.0-rc", "lib/net6.0/Y.One.xml"),
                ("y", "1.0-rc", "tools/Y.Tool.dll"), ("y", "2.0", "lib/Y.New.dll"), ("x", "1.0", "lib/X.Listed.dll"),
            ],
            "package string, version string, path string",
        )
    )
    found = resolve.resolve_assemblies(jobs, paths, listing).collect()
    assert {(r["solution"], r["package"], r["assembly_lc"], r["tier"]) for r in found} == {
        ("s", "X", "x.core", 1),
        ("s", "X", "x.bson", 1),  # a name inside another is caught too
        ("s", "Y", "y.one", 2),
        ("s", "Y", "y.two", 2),
        ("s", "Z", "z", 3),
        ("t", "X", "x.listed", 2),
    }
    strict = resolve.assemblies_from_paths(paths, jobs, strict=True).collect()
    assert {(r["package"], r["assembly_lc"]) for r in strict} == {("X", "x.core")}


def test_plain_folder_counts_lib_only(spark):
    rows = [("p", "1", "lib/net6.0/A.dll", False), ("p", "1", "ref/net6.0/B.dll", False)]
    files = spark.createDataFrame(rows, "package string, version string, path string, from_archive boolean")
    assert [r["assembly_lc"] for r in assemblies_from_listing(files).collect()] == ["a"]
