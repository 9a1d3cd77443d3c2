"""Checks over manifests, declared packages and counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.functions.paths import file_name


@dataclass(frozen=True)
class Rule:
    """One check over the files whose name matches ``scope``.

    ``per`` is ``file`` (once per file with a matching line), ``line`` (once per
    matching line; the line is the detail) or ``name`` (the file's presence).
    """

    check: str
    scope: str
    per: str
    detail: str = ""
    pattern: str = ""


MANIFEST = r"\.(csproj|targets|props)$"

# The checks, in reporting order. Patterns use (?i) where case is ignored.
MANIFEST_RULES = [
    Rule("UsingTask", MANIFEST, "file", "defines or references a custom MSBuild task", "UsingTask"),
    Rule("Exec", MANIFEST, "file", "runs an <Exec> command as part of the build", r"<Exec\s"),
    Rule("T4", r"\.tt$", "name", "T4 template file present"),
    Rule("InstallScript", r"(?i)^(install|init)\.ps1$", "name", "NuGet install/init PowerShell script present"),
    Rule(
        "Analyzer/SourceGenerator",
        MANIFEST,
        "line",
        pattern=r'(?i)<(Package|Project)Reference[^>]*Include="[^"]*(Analyzer|SourceGenerator)[^"]*"',
    ),
    Rule("Analyzer/SourceGenerator", MANIFEST, "line", pattern=r'(?i)OutputItemType="Analyzer"'),
]


def _violations(rule: Rule, lines: Column, name: Column) -> Column:
    """Array of this rule's violations in one file."""

    def hit(detail: Column) -> Column:
        return F.struct(F.lit(rule.check).alias("check"), detail.alias("detail"))

    none = F.array().cast("array<struct<check:string,detail:string>>")
    in_scope = name.rlike(rule.scope)
    once = F.array(hit(F.lit(rule.detail)))
    if rule.per == "name":
        return F.when(in_scope, once).otherwise(none)
    if rule.per == "file":
        return F.when(in_scope & F.exists(lines, lambda x: x.rlike(rule.pattern)), once).otherwise(none)
    numbered = F.transform(
        lines, lambda x, i: F.struct(x.alias("line"), F.concat((i + 1).cast("string"), F.lit(":"), x).alias("detail"))
    )
    matching = F.filter(numbered, lambda x: x["line"].rlike(rule.pattern))
    return F.when(in_scope, F.transform(matching, lambda x: hit(x["detail"]))).otherwise(none)


def rule_scan(files: DataFrame, rules: list[Rule] = MANIFEST_RULES, scope_column: str | None = None) -> DataFrame:
    """``(file_path, check, detail)`` per violation. One narrow pass, whatever the number of rules.

    Rules look at the file name, or at ``scope_column`` if given. Lines end at a
    line feed; a line rule reports every matching line, one row per rule.
    """
    name = F.col(scope_column) if scope_column else file_name(F.col("file_path"))
    found = F.concat(*[_violations(r, F.col("_lines"), name) for r in rules])
    return (
        files.withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n"))
        .select("file_path", F.explode(found).alias("v"))
        .select("file_path", "v.check", "v.detail")
    )


def scan_summary(files: DataFrame, violations: DataFrame) -> DataFrame:
    """File counts by kind, number of violations and ``clean``.

    No manifest at all is an error: nothing was checked out, nothing was checked.
    """
    name = file_name(F.col("file_path"))
    rows = files.select(name.alias("name"), F.lit(False).alias("violation")).unionByName(
        violations.select(F.lit("").alias("name"), F.lit(True).alias("violation"))
    )
    counted = rows.agg(
        F.count_if(F.col("name").rlike(MANIFEST)).alias("manifests"),
        F.count_if(F.col("name").rlike(r"\.tt$")).alias("templates"),
        F.count_if(F.col("name").rlike(r"(?i)^(install|init)\.ps1$")).alias("install_scripts"),
        F.count_if("violation").alias("violations"),
    )
    guard = F.raise_error(F.lit("no manifest found: an empty scan is not a clean scan")).cast("bigint")
    return counted.select(
        F.when(F.col("manifests") == 0, guard).otherwise(F.col("manifests")).alias("manifests"),
        "templates",
        "install_scripts",
        "violations",
        (F.col("violations") == 0).alias("clean"),
    )


def unused_packages(declared: DataFrame, usages: DataFrame, on: list[str]) -> DataFrame:
    """Declared packages without any usage. Usages are reduced to their keys before the join."""
    return declared.join(usages.select(*on).distinct(), on, "left_anti")


def check_expectations(expectations: DataFrame, counts: DataFrame) -> DataFrame:
    """Compare ``counts(check_name, n[, errors])`` with ``expectations(check_name, lo, hi)``.

    A check passes if the count is within bounds and there are no errors; an
    expectation without any rows counts 0.
    """
    errors = F.coalesce(F.col("errors"), F.lit(0)) if "errors" in counts.columns else F.lit(0)
    return (
        expectations.join(counts, "check_name", "left")
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
        .withColumn("passed", F.col("n").between(F.col("lo"), F.col("hi")) & (errors == 0))
    )
