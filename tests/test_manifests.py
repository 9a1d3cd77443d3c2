"""Manifests as they are written: comments, quotes, inner elements, updates and what folders give."""

from refscope.sources import packages as P

PROJECT = """<Project Sdk="Microsoft.NET.Sdk" xmlns="http://schemas.microsoft.com/developer/msbuild/2003">
  <!-- <PackageReference Include="Gone" Version="1" /> -->
  <ItemGroup Condition="'$(F)' == 'net8'">
    <PackageReference Include='Single' Version='1.0' />
    <PackageReference
        Version="2.0"  Include="Turned"></PackageReference>
    <PackageReference Include="Inner"><PrivateAssets>all</PrivateAssets><Version> 3.0 </Version></PackageReference>
    <PackageReference Include="Odd>Name &amp; Co" Version="4"/>
    <PackageReference Include="One; Two" Version="5"/>
    <PackageReference Include="Bare" /><PackageReference Include="bare2"/>
    <PackageReference Update="Shared" Version="6"/>
    <PackageReference Update="Nowhere" Version="6"/>
    <PackageReference Remove="Unwanted"/>
    <PackageReference Include="Over" VersionOverride="7"/>
    <PackageReferenceX Include="NotThis" Version="9"/>
  </ItemGroup>
  <Choose><When><ItemGroup><PackageReference Include="Deep" Version="8" /></ItemGroup></When></Choose>
</Project>"""


def manifests(spark, rows):
    return spark.createDataFrame(rows, "solution string, project_name string, file_path string, text string")


def test_elements_of_one_manifest(spark):
    rows = manifests(spark, [("s", "p", "p.csproj", PROJECT), ("s", "q", "q.csproj", None), ("s", "r", "r.csproj", "<PackageReference Include=")])
    got = {(r.package, r.version) for r in P.declared_packages(rows.drop("file_path")).collect()}
    assert got == {
        ("Single", "1.0"), ("Turned", "2.0"), ("Inner", "3.0"), ("Odd>Name & Co", "4"), ("One", "5"), ("Two", "5"), ("Bare", ""),
        ("bare2", ""), ("Over", "7"), ("Deep", "8"),
    }
    assert {r.package for r in P.package_references(rows).collect()} == {p for p, _ in got}


def test_what_the_folders_above_give(spark):
    central = '<Project><ItemGroup><PackageVersion Include="BARE" Version="10"/><PackageVersion Include="{}" Version="11"/></ItemGroup></Project>'
    shared = (
        '<Project><PackageReference Include="Shared" Version="20"/><PackageReference Include="Unwanted" Version="20"/>'
        '<PackageReference Include="Analyzer"/><PackageReference Include="Over" Version="20"/></Project>'
    )
    rows = manifests(
        spark,
        [
            ("s", "p", "src/p/p.csproj", PROJECT),
            ("s", "plain", "src/plain/plain.csproj", "<Project/>"),
            ("s", "top", "top.csproj", '<PackageReference Include="Bare"/>'),
            ("s", "deep", "src/x/y/deep.csproj", '<PackageReference Include="Bare"/><PackageReference Include="Bare" Version="1"/>'),
            ("s", None, "Directory.Packages.props", central.format("Analyzer")),
            ("s", None, "src/x/directory.packages.props", '<PackageVersion Include="Bare" Version="12"/><PackageVersion Update="bare" Version="13"/>'),
            ("s", None, "src/Directory.Build.props", shared),
            ("s", None, "src/x/y/Directory.Build.props", "<Project></Project>"),
            ("other", None, "Directory.Packages.props", central.format("Bare2")),
        ],
    )
    got = {}
    for r in P.declared_tree(rows).collect():
        got.setdefault(r.project_name, set()).add((r.package, r.version, r.origin))
    own = {("Single", "1.0"), ("Turned", "2.0"), ("Inner", "3.0"), ("Odd>Name & Co", "4"), ("One", "5"), ("Two", "5"), ("Bare", "10"), ("bare2", ""), ("Over", "7"), ("Deep", "8")}
    assert got["p"] == {(*x, "own") for x in own} | {("Shared", "6", "shared"), ("Analyzer", "11", "shared")}
    assert got["plain"] == {("Shared", "20", "shared"), ("Unwanted", "20", "shared"), ("Analyzer", "11", "shared"), ("Over", "20", "shared")}
    assert got["top"] == {("Bare", "10", "own")}
    assert got["deep"] == {("Bare", "13", "own"), ("Bare", "1", "own")}
    assert P.declared_tree(rows.limit(0)).count() == 0


def test_long_manifests(spark):
    many = "".join(f'<PackageReference Include="P{i}" Version="{i}"/><!-- {"x" * 50} -->' for i in range(5000))
    rows = manifests(spark, [("s", "p", "p.csproj", many), ("s", "q", "q.csproj", "<!--" + "-" * 500_000), ("s", "r", "r", "<PackageReference " + "a" * 500_000)])
    assert P.declared_tree(rows).count() == 5000
