"""Which results can be reused and which must be computed again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.config import AnalysisOptions
from refscope.operators.match import parse_usage_types
from refscope.operators.snapshot import digest_parts, digest_sums, digest_text, file_digest


def iso_ticks(ts: Column) -> Column:
    """UTC round-trip format with seven fractional digits."""
    return F.concat(utc_text(ts), F.lit("0Z"))


def utc_text(ts: Column) -> Column:
    """A point in time in UTC, to the microsecond, whatever the session's time zone.

    A timestamp without zone is taken as UTC.
    """
    wall = ts.cast("timestamp_ntz")
    shifted = F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall)
    shown = F.when(F.typeof(ts) == "timestamp_ntz", wall).otherwise(shifted).cast("string")
    clock = F.replace(F.substring(shown, 1, 19), F.lit(" "), F.lit("T"))
    return F.concat(clock, F.lit("."), F.rpad(F.substring(shown, 21, 6), 6, "0"))


def settings_text(options: AnalysisOptions) -> str:
    """The settings that change a result, as text; empty for the defaults."""
    types = options.usage_types if options.usage_types is not None else options.configured_usage_types
    wanted = sorted(set(parse_usage_types(types)))
    out = ""
    if wanted:
        out += "|types:" + ",".join(wanted)
    if options.similarity.enabled:
        out += "|similarity:" + options.similarity.describe()
    if options.strict_paths:
        out += "|strict"
    if options.match_member:
        out += "|member"
    return out


def fingerprint(
    jobs: DataFrame,
    source_state: DataFrame,
    options: AnalysisOptions = AnalysisOptions(),
    assemblies: DataFrame | None = None,
) -> DataFrame:
    """Add ``fingerprint`` to jobs ``(solution, package, version[, context_lines])``.

    ``source_state(solution, mtime)`` holds the newest source time per solution,
    so a changed source invalidates, not only a changed solution file. With
    ``files`` and ``digest``, as ``source_state`` below and ``source_digest`` of a snapshot
    give them, a removed or renamed file does so too, and one restored with an old time. Settings
    other than the defaults are part of the key, and so is, where
    ``assemblies(job_id, assembly_lc)`` is given, what a job's package was resolved
    to: a changed listing or path makes another key. A solution without known
    state gets no fingerprint and is never a hit.
    """
    around = F.col("context_lines") if "context_lines" in jobs.columns else F.lit(options.context_lines)
    key = F.concat(
        F.concat_ws("|", "solution", "package", "version"),
        F.lit("|"),
        iso_ticks(F.col("mtime")),
        F.lit("|context:"),
        around.cast("string"),
        F.lit(settings_text(options)),
    )
    state = [c for c in ("mtime", "files", "digest") if c in source_state.columns]
    keyed = jobs.join(source_state.select("solution", *state), "solution", "left")
    if "digest" in state:
        key = F.concat(key, F.lit("|files:"), F.concat_ws("|", F.col("files").cast("string"), "digest"))
    if assemblies is None:
        return keyed.withColumn("fingerprint", F.sha2(key, 256)).drop(*state)
    names = assemblies.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_set("assembly_lc")), ",").alias("names"))
    key = F.concat(key, F.lit("|assemblies:"), F.coalesce("names", F.lit("")))
    return keyed.join(names, "job_id", "left").withColumn("fingerprint", F.sha2(key, 256)).drop(*state, "names")


def source_state(files: DataFrame) -> DataFrame:
    """``(solution, mtime, files, digest)`` of ``files(solution, file_path, mtime[, text])``: newest time, number, and digest of all files."""
    content = [c for c in ("mtime", "text") if c in files.columns]
    rows = files.select("solution", "mtime", *digest_parts(file_digest(F.col("file_path"), *map(F.col, content))))
    summed = rows.groupBy("solution").agg(F.max("mtime").alias("mtime"), F.count(F.lit(1)).alias("files"), *digest_sums())
    return summed.select("solution", "mtime", "files", digest_text().alias("digest"))


def split_jobs(jobs: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to run, to reuse): forced and unknown jobs run, the others are served from ``stored``."""
    known = stored.select("fingerprint").distinct()
    reusable = jobs.where(~F.col("force_refresh"))
    misses = reusable.join(known, "fingerprint", "left_anti")
    forced = jobs.where(F.col("force_refresh"))
    return forced.unionByName(misses), reusable.join(known, "fingerprint", "left_semi")


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Files that are new or newer than their stored state, by their times alone.

    Deleted files are not listed; ``snapshot_diff`` compares whole snapshots and lists them.
    """
    old = stored.groupBy("solution", "file_path").agg(F.max("mtime").alias("stored_mtime"))
    return (
        current.join(old, ["solution", "file_path"], "left")
        .where(F.col("stored_mtime").isNull() | (F.col("stored_mtime") < F.col("mtime")))
        .drop("stored_mtime")
    )
