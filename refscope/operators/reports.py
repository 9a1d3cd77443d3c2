"""Counts, summaries and JSON reports over usages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.operators.incremental import utc_text
from refscope.runtime import cut, join_bounded
from refscope.schemas import USAGE_ORDER


def usage_by_project(usages: DataFrame) -> DataFrame:
    return usages.groupBy("job_id", "project_name").agg(F.count("*").alias("usages"))


def usage_by_project_type(usages: DataFrame) -> DataFrame:
    return usages.groupBy("job_id", "project_name", "usage_type").agg(F.count("*").alias("usages"))


def usage_rollup(usages: DataFrame) -> DataFrame:
    """Job, project and type totals in one pass; ``level`` 0 = type, 1 = project, 3 = job.

    Counted by type first: only the few counted rows are expanded into levels.
    """
    counted = usage_by_project_type(usages)
    return (
        counted.rollup("job_id", "project_name", "usage_type")
        .agg(F.sum("usages").alias("usages"), F.grouping_id().cast("int").alias("level"))
        .where(F.col("job_id").isNotNull())
        .select("job_id", "project_name", "usage_type", "level", "usages")
    )


def usage_spread(usages: DataFrame) -> DataFrame:
    """How widely each job's target is used: usages, files, projects, symbols."""
    return usages.groupBy("job_id").agg(
        F.count("*").alias("usages"),
        F.countDistinct("file_path").alias("files"),
        F.countDistinct("project_name").alias("projects"),
        F.countDistinct("symbol_name").alias("symbols"),
    )


def usage_spread_approx(usages: DataFrame, error: float = 0.02) -> DataFrame:
    """As ``usage_spread``, with sketches in one pass for very large tables."""
    return usages.groupBy("job_id").agg(
        F.count("*").alias("usages"),
        F.approx_count_distinct("file_path", error).alias("files"),
        F.approx_count_distinct("project_name", error).alias("projects"),
        F.approx_count_distinct("symbol_name", error).alias("symbols"),
    )


# What is counted once however often it occurs: name and column.
SPREAD = {"files": "file_path", "projects": "project_name", "symbols": "symbol_name"}


def usage_sketches(usages: DataFrame, by: str = "job_id", lg: int = 12) -> DataFrame:
    """``(by, usages, files, projects, symbols)``: a count and three sketches of distinct values.

    A sketch is at most some 2 ** ``lg`` bytes and estimates with a standard error of about 1.04 / sqrt(2 ** ``lg``): 1.6 %
    as set. Sketches are merged by ``merged_spread``, so the spread of any union of jobs needs no usage. Nulls
    are no value.
    """
    sketches = [F.hll_sketch_agg(column, lg).alias(name) for name, column in SPREAD.items()]
    return usages.groupBy(by).agg(F.count("*").alias("usages"), *sketches)


def merged_spread(sketches: DataFrame, *by: str) -> DataFrame:
    """As ``usage_spread`` for groups of results by their sketches: usages exactly, the others estimated.

    A value that several results of a group share counts once; a group of results without usages has zeros.
    """
    merged = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0)).alias(name) for name in SPREAD]
    return sketches.groupBy(*by).agg(F.coalesce(F.sum("usages"), F.lit(0)).alias("usages"), *merged)


def duration_text(milliseconds: Column) -> Column:
    """``hh:mm:ss.fff``; whole days are not shown."""

    def part(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    ms = milliseconds.cast("bigint")
    whole = F.floor(ms / 1000).cast("bigint")
    return F.concat(
        part(F.floor(whole / 3600).cast("bigint") % 24, 2), F.lit(":"),
        part(F.floor(whole / 60).cast("bigint") % 60, 2), F.lit(":"),
        part(whole % 60, 2), F.lit("."),
        part(ms % 1000, 3),
    )


def summary(analyses: DataFrame, usages: DataFrame, job_projects: DataFrame, job_errors: DataFrame) -> DataFrame:
    """``analyses`` (one row per job) with its totals; jobs without rows count 0.

    Each child table is counted by job before it meets the others.
    """

    def totals(child: DataFrame, name: str) -> DataFrame:
        return child.groupBy("job_id").agg(F.count("*").alias(name))

    out = (
        analyses.join(totals(usages, "total_usage_count"), "job_id", "left")
        .join(totals(job_projects.select("job_id", "project_name").distinct(), "analyzed_project_count"), "job_id", "left")
        .join(totals(job_errors, "error_count"), "job_id", "left")
    )
    return out.na.fill(0, ["total_usage_count", "analyzed_project_count", "error_count"])


def merge_results(parts: list[DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge per-project outcomes into usages, analysed projects and errors.

    Each part has the usage columns plus ``error``. A row with an error stands
    for a failed project and becomes a message; the other projects go on.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    failed = F.col("error").isNotNull()
    usages = rows.where(~failed).drop("error")
    projects = rows.select("job_id", "project_name").distinct()
    errors = (
        rows.where(failed)
        .select("job_id", error_message(F.col("project_name"), F.col("error")).alias("error"))
        .distinct()
    )
    return usages, projects, errors


def error_message(project: Column, message: Column) -> Column:
    return F.concat(F.lit("Project "), project, F.lit(": "), message)


def batch_results(jobs: DataFrame, usages: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per job: ``success``, ``error`` and ``usage_count``; a failed job has no count."""
    counts = usages.groupBy("job_id").agg(F.count("*").alias("n"))
    reasons = failures.groupBy("job_id").agg(F.min("error").alias("error"))
    return (
        jobs.join(counts, "job_id", "left")
        .join(reasons, "job_id", "left")
        .withColumn("success", F.col("error").isNull())
        .withColumn("usage_count", F.when(F.col("success"), F.coalesce("n", F.lit(0))))
        .drop("n")
    )


def batch_outcome(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("success")).alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum("usage_count"), F.lit(0)).alias("usages"),
    )


def detailed_report(usages: DataFrame) -> DataFrame:
    """Usages ordered by job, project, file and line; the rest of the order breaks ties."""
    return usages.orderBy("job_id", *USAGE_ORDER)


# --- JSON ---------------------------------------------------------------------

KEEP_NULLS = {"ignoreNullFields": "false"}


def _camel(name: Column) -> Column:
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def usage_object(pascal: bool = False) -> Column:
    """One usage as a JSON object: the report's nine fields, or all twelve of a full result."""
    fields = [
        ("projectName", "project_name"),
        ("filePath", "file_path"),
        ("startLine", "start_line"),
        ("endLine", "end_line"),
        ("codeText", "code_text"),
    ]
    if pascal:
        fields += [
            ("type", "usage_type"),
            ("symbolName", "symbol_name"),
            ("namespace", "namespace"),
            ("assemblyName", "assembly_name"),
            ("contextStartLine", "context_start_line"),
            ("contextEndLine", "context_end_line"),
            ("hasContext", "has_context"),
        ]
        columns = [F.col(c).alias(n[0].upper() + n[1:]) for n, c in fields]
    else:
        columns = [F.col(c).alias(n) for n, c in fields] + [
            _camel(F.col("usage_type")).alias("usageType"),
            F.col("symbol_name").alias("symbolName"),
            F.col("namespace"),
            F.col("assembly_name").alias("assemblyName"),
        ]
    return F.to_json(F.struct(*columns), KEEP_NULLS)


# Parts of a report in reading order.
PARTS = ("summary", "project", "usage", "error")


def _parts(
    head: DataFrame, usages: DataFrame, job_projects: DataFrame, job_errors: DataFrame, pascal: bool
) -> DataFrame:
    """``(job_id, part, position, json)``: a report as rows, the same for every size.

    One row for the head, one for each project, usage and error; nothing is
    gathered per job. Sorted by job, part, position and json the rows read as the
    report; ``part`` numbers ``PARTS``.
    """

    def rows(df: DataFrame, part: str, position: Column, value: Column) -> DataFrame:
        number = F.lit(PARTS.index(part)).alias("part")
        return df.select("job_id", number, position.alias("position"), value.alias("json"))

    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^.(.*).$", 1)
    numbers = [F.lpad(F.col(c).cast("string"), 10, "0") for c in ("start_line", "end_line")]
    place = F.concat_ws("|", "project_name", "file_path", *numbers, "usage_type", "symbol_name")
    projects = job_projects.select("job_id", "project_name").distinct()
    return (
        rows(head, "summary", F.lit(""), F.col("head"))
        .unionByName(rows(projects, "project", F.col("project_name"), quoted("project_name")))
        .unionByName(rows(usages, "usage", place, usage_object(pascal)))
        .unionByName(rows(job_errors, "error", F.col("error"), quoted("error")))
    )


def write_report(report: DataFrame, path: str) -> None:
    """Store a report in reading order: files and their rows are sorted by job, part, position and json."""
    order = ["job_id", "part", "position", "json"]
    # Written first: the ranges are found by a sample, which would compute the report once more.
    cut(report, "report").repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


# The names of a document's arrays, by part.
ARRAYS = ("", "analyzedProjects", "usages", "errors")
OPENING, ITEM, CLOSING = range(3)
DOCUMENT_ORDER = ("job_id", "part", "slot", "position", "json", "copy")


def documents(report: DataFrame, pascal: bool = False) -> DataFrame:
    """``(job_id, part, slot, position, json, copy, text)``: a report's parts as one JSON document per job.

    The rows' ``text`` in ``DOCUMENT_ORDER`` is the document. Nothing is gathered per job: brackets are rows of
    their own, made from the head, and a comma stands before every item that is not the first of its array, which is
    found by a minimum. A camel-case report has its head as ``summary``, a ``pascal`` result has the head's fields
    beside its arrays. Equal items stay, told apart by ``copy``; empty arrays are written out. A job without a
    head has no document.
    """
    rows = cut(report.withColumn("copy", F.monotonically_increasing_id()), "document")
    heads = rows.where(F.col("part") == 0).select("job_id", F.col("json").alias("head"))
    names = [name[:1].upper() + name[1:] if pascal else name for name in ARRAYS]
    head = F.substr("head", F.lit(1), F.char_length("head") - 1) if pascal else F.concat(F.lit('{"summary":'), "head")

    def bracket(part: int, slot: int, text: Column | str) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(slot).alias("slot"), (F.lit(text) if isinstance(text, str) else text).alias("text"))

    brackets = [bracket(0, OPENING, head)]
    for part in range(1, len(PARTS)):
        brackets.append(bracket(part, OPENING, f',"{names[part]}":['))
        brackets.append(bracket(part, CLOSING, "]" if part + 1 < len(PARTS) else "]}"))
    frame = heads.select("job_id", F.explode(F.array(*brackets)).alias("b")).select(
        "job_id", "b.part", "b.slot", F.lit("").alias("position"), F.lit("").alias("json"), F.lit(0).cast("bigint").alias("copy"), "b.text"
    )
    items, place = rows.where(F.col("part") > 0), F.struct("position", "json", "copy")
    first = items.groupBy("job_id", "part").agg(F.min(place).alias("first"))
    first = first.join(heads.select("job_id"), "job_id", "left_semi")
    items = join_bounded(items, first, ["job_id", "part"])
    text = F.concat(F.when(place == F.col("first"), "").otherwise(","), "json")
    return frame.unionByName(items.select("job_id", "part", F.lit(ITEM).alias("slot"), "position", "json", "copy", text.alias("text")))


def write_documents(lines: DataFrame, path: str) -> None:
    """Store ``documents`` as text, a folder per job: its files in the order of their names are the document.

    Rows are dealt by ranges of the order, so a job of any size is written by as many tasks as it needs, each with one
    open file at a time.
    """
    order = list(DOCUMENT_ORDER)
    dealt = cut(lines, "lines").repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("job_id", "text").write.partitionBy("job_id").text(path)


def _timestamp(ts: Column) -> Column:
    return F.concat(utc_text(ts), F.lit("Z"))


def usage_report(
    summaries: DataFrame, usages: DataFrame, job_projects: DataFrame, job_errors: DataFrame, symbol: bool = False
) -> DataFrame:
    """The camel-case report of package jobs, or of symbol jobs if ``symbol``, in parts."""
    subject = (
        [F.col("target").alias("targetSymbol")]
        if symbol
        else [F.col("package").alias("packageName"), F.col("version").alias("packageVersion")]
    )
    fields = F.struct(
        F.col("solution").alias("solutionPath"),
        *subject,
        _timestamp(F.col("analyzed_at")).alias("analyzedAt"),
        duration_text(F.col("duration_ms")).alias("analysisDuration"),
        F.col("total_usage_count").alias("totalUsageCount"),
        F.col("analyzed_project_count").alias("analyzedProjectCount"),
        F.col("error_count").alias("errorCount"),
    )
    head = summaries.select("job_id", F.to_json(fields, KEEP_NULLS).alias("head"))
    return _parts(head, usages, job_projects, job_errors, pascal=False)


def full_result(
    summaries: DataFrame, usages: DataFrame, job_projects: DataFrame, job_errors: DataFrame, symbol: bool = False
) -> DataFrame:
    """The Pascal-case result with every usage field, context bounds included, in parts.

    A symbol job is named ``symbol:`` and its target, its version is ``N/A``.
    """
    name = F.concat(F.lit("symbol:"), F.col("target")) if symbol else F.col("package")
    fields = F.struct(
        F.col("solution").alias("SolutionPath"),
        name.alias("PackageName"),
        (F.lit("N/A") if symbol else F.col("version")).alias("PackageVersion"),
        _timestamp(F.col("analyzed_at")).alias("AnalyzedAt"),
        duration_text(F.col("duration_ms")).alias("AnalysisDuration"),
        F.col("total_usage_count").alias("TotalUsageCount"),
    )
    head = summaries.select("job_id", F.to_json(fields, KEEP_NULLS).alias("head"))
    return _parts(head, usages, job_projects, job_errors, pascal=True)


def error_report(failures: DataFrame, symbol: bool = False) -> DataFrame:
    """One JSON object per failed job."""
    subject = (
        [F.col("target").alias("targetSymbol")]
        if symbol
        else [F.col("package").alias("packageName"), F.col("version").alias("packageVersion")]
    )
    fields = F.struct(
        F.col("error"), F.col("solution").alias("solutionPath"), *subject, _timestamp(F.col("failed_at")).alias("timestamp")
    )
    return failures.select("job_id", F.to_json(fields, KEEP_NULLS).alias("json"))
