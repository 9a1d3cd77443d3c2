"""The whole analyses: many jobs, one plan."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refscope.config import AnalysisOptions
from refscope.functions.text import simplify
from refscope.operators.context import attach_context
from refscope.operators.dedup import near_dedup
from refscope.operators.match import filter_usage_types, match_assembly, match_symbol, of_assemblies
from refscope.operators.refs import expand_nodes, is_usage, to_usages
from refscope.operators.audit import unused_packages
from refscope.operators.reports import batch_outcome, batch_results, documents, error_message, full_result, summary, usage_report
from refscope.operators.resolve import job_assemblies, resolve_assemblies
from refscope.operators.incremental import fingerprint, split_jobs
from refscope.runtime import cut, fits_broadcast, join_bounded
from refscope.schemas import USAGE_COLUMNS, USAGE_ORDER
from refscope.sources.packages import declared_packages, declared_tree
from refscope.operators.snapshot import snapshot, snapshot_diff
from refscope.sources.changes import ChangeStore, of_files, question
from refscope.sources.results import load_results, save_results, stored_headers


@dataclass
class Tables:
    """Inputs of an analysis. ``files`` is needed only where context is asked for."""

    refs: DataFrame
    projects: DataFrame  # solution, project_name
    reference_paths: DataFrame | None = None  # solution, path
    package_assemblies: DataFrame | None = None  # package, version, assembly_lc
    files: DataFrame | None = None  # solution, file_path, text
    project_errors: DataFrame | None = None  # solution, project_name, error


@dataclass
class Analysis:
    """Result tables, all keyed by ``job_id``.

    ``jobs`` carries ``analyzed_at`` and ``duration_ms``. All jobs of a run are
    one plan and share its times, unless the jobs came with times of their own.
    """

    jobs: DataFrame
    usages: DataFrame
    job_projects: DataFrame
    job_errors: DataFrame
    symbol: bool = False

    def summary(self) -> DataFrame:
        return summary(self.jobs, self.usages, self.job_projects, self.job_errors)

    def report(self) -> DataFrame:
        """The camel-case report in parts."""
        return usage_report(self.summary(), self.usages, self.job_projects, self.job_errors, self.symbol)

    def result(self) -> DataFrame:
        """The full Pascal-case result in parts."""
        return full_result(self.summary(), self.usages, self.job_projects, self.job_errors, self.symbol)

    def documents(self, pascal: bool = False) -> DataFrame:
        """The report, or the full result if ``pascal``, as lines of one JSON document per job."""
        return documents(self.result() if pascal else self.report(), pascal)


def _finish(
    jobs: DataFrame, matched: DataFrame, tables: Tables, options: AnalysisOptions, started: float, symbol: bool = False
) -> Analysis:
    """Context, near-duplicates, then usage types: the order decides the result.

    The usages are written: counts, reports and stores read them, none computes them again.
    """
    usages = to_usages(matched)
    asks_context = options.context_lines > 0 or "context_lines" in jobs.columns
    if asks_context:
        if tables.files is None:
            raise ValueError("context lines need the source files")
        if "context_lines" in jobs.columns:
            usages = join_bounded(usages, jobs.select("job_id", "context_lines"), ["job_id"])
        else:
            usages = usages.withColumn("context_lines", F.lit(options.context_lines))
        # Read twice, for positions and for rows: written once instead of matched twice.
        usages = attach_context(cut(usages, "usages"), tables.files)
    usages = near_dedup(usages.select(*USAGE_COLUMNS), options.similarity)
    usages = filter_usage_types(usages, options.usage_types, options.configured_usage_types)
    return _analysis(jobs, cut(usages, "found"), tables, started, symbol)


def _analysis(jobs: DataFrame, usages: DataFrame, tables: Tables, started: float, symbol: bool) -> Analysis:
    """Add the run's times, every job's projects (also those without usages) and project errors."""
    took = {
        "analyzed_at": F.lit(datetime.fromtimestamp(started, UTC)),
        "duration_ms": F.lit(int((time.time() - started) * 1000)).cast("bigint"),
    }
    jobs = jobs.withColumns({name: value for name, value in took.items() if name not in jobs.columns})
    scoped = jobs.select("job_id", "solution")
    job_projects = scoped.join(tables.projects.select("solution", "project_name").distinct(), "solution").select(
        "job_id", "project_name"
    )
    errors = scoped.select("job_id", F.lit(None).cast("string").alias("error")).where(F.lit(False))
    if tables.project_errors is not None:
        errors = scoped.join(tables.project_errors, "solution").select(
            "job_id", error_message(F.col("project_name"), F.col("error")).alias("error")
        )
    return Analysis(jobs, usages, job_projects, errors, symbol)


def analyze_package(jobs: DataFrame, tables: Tables, options: AnalysisOptions = AnalysisOptions()) -> Analysis:
    """Usages of packages. ``jobs(job_id, solution, package, version[, context_lines])``.

    The references are scanned once for all jobs. Projects without any usage
    stay listed. Missing input tables raise; failed projects become errors.
    """
    if tables.reference_paths is None or tables.package_assemblies is None:
        raise ValueError("package jobs need reference paths and package assemblies")
    started = time.time()
    wanted = _job_assemblies(jobs, tables, options)
    return _finish(jobs, match_assembly(expand_nodes(tables.refs), wanted), tables, options, started)


def _job_assemblies(jobs: DataFrame, tables: Tables, options: AnalysisOptions) -> DataFrame:
    resolved = resolve_assemblies(jobs, tables.reference_paths, tables.package_assemblies, options.strict_paths)
    return job_assemblies(jobs, resolved)


def analyze_symbol(jobs: DataFrame, tables: Tables, options: AnalysisOptions = AnalysisOptions()) -> Analysis:
    """Usages of namespaces, types or members. ``jobs(job_id, solution, target[, context_lines])``."""
    started = time.time()
    targets = jobs.select("job_id", "solution", "target")
    matched = match_symbol(expand_nodes(tables.refs), targets, options.match_member)
    return _finish(jobs, matched, tables, options, started, symbol=True)


def analyze_declared(
    manifests: DataFrame, tables: Tables, options: AnalysisOptions = AnalysisOptions()
) -> tuple[Analysis, DataFrame]:
    """(usages of all declared packages, declared packages no one uses).

    ``manifests(solution, project_name, text)``; with ``file_path``, what the property
    files of a manifest's folders declare counts as well. Every package that a manifest
    declares is a job of its solution. The second table, ``(solution,
    project_name, package, version)``, lists what a project declares without
    any reference of that project into the package's assemblies; all references
    count, whatever similarity or usage types ``options`` ask for.
    """
    if "file_path" in manifests.columns:
        declared = declared_tree(manifests).select("solution", "project_name", "package", "version").distinct()
    else:
        declared = declared_packages(manifests.select("solution", "project_name", "text"))
    declared = cut(declared, "declared")
    job = F.concat_ws("|", "solution", "package", "version").alias("job_id")
    jobs = declared.select(job, "solution", "package", "version").distinct()
    every = AnalysisOptions(strict_paths=options.strict_paths)
    found = analyze_package(cut(jobs, "declared-jobs"), tables, every)
    used = found.usages.select("job_id", "solution", "project_name").distinct()
    used = used.join(found.jobs.select("job_id", "package", "version"), "job_id")
    return found, unused_packages(declared, used, ["solution", "project_name", "package", "version"])


def analyze_batch(
    jobs: DataFrame, tables: Tables, options: AnalysisOptions = AnalysisOptions()
) -> tuple[DataFrame, DataFrame]:
    """(one row per job, totals) of a job list.

    A job whose solution is unknown fails and does not stop the others. Batch
    runs use no context and no explicit usage types.
    """
    known, failures = _known_jobs(jobs, tables)
    results = batch_results(jobs, analyze_package(known, tables, _batch_options(options)).usages, failures)
    return results, batch_outcome(results)


def _batch_options(options: AnalysisOptions) -> AnalysisOptions:
    return AnalysisOptions(
        similarity=options.similarity,
        configured_usage_types=options.configured_usage_types,
        strict_paths=options.strict_paths,
    )


def _known_jobs(jobs: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(jobs of known solutions, error rows of the others)."""
    known = tables.projects.select("solution").distinct()
    failures = jobs.join(known, "solution", "left_anti").select(
        "job_id", F.concat(F.lit("Solution not found: "), F.col("solution")).alias("error")
    )
    return jobs.join(known, "solution", "left_semi").drop("context_lines"), failures


def analyze_isolated(
    jobs: DataFrame, tables: Tables, options: AnalysisOptions = AnalysisOptions()
) -> tuple[DataFrame, DataFrame]:
    """As ``analyze_batch``, but a job that cannot be computed fails alone, with the reason as its error.

    References are matched once for all jobs and stored; an error there ends the run. What runs on a job's texts, the
    caller's simplifiers and comparisons among it, runs for all jobs together. If that fails, the jobs
    are halved by a hash of their id, again and again, until what fails is one job. The simplifiers are tried first, by
    themselves: a run of one stage. With b failing jobs of n these are about 2 * b * log2(n) runs. The stored usages lie
    in order of the hash, so a run reads the pages of its group and no others, and each level costs half of the one
    before. Failed jobs are left out as the usages are read. A plan that is wrong for every job (``AnalysisException``)
    is raised.
    """
    plain = _batch_options(options)
    known, failures = _known_jobs(jobs, tables)
    wanted = cut(_job_assemblies(known, tables, plain), "wanted")
    # Counts need what near-duplicates are told by and what puts them in order; the rest is not stored.
    usages = to_usages(match_assembly(expand_nodes(tables.refs), wanted)).select("job_id", *USAGE_ORDER)
    usages = cut(usages.withColumn("_hash", F.xxhash64("job_id")).sortWithinPartitions("_hash"), "usages")

    def simplified(group: DataFrame) -> None:
        group.select(simplify(F.col("code_text"), plain.similarity)).write.format("noop").mode("overwrite").save()

    def counted(group: DataFrame) -> DataFrame:
        kept = near_dedup(group.drop("_hash"), plain.similarity)
        kept = filter_usage_types(kept, plain.usage_types, plain.configured_usage_types)
        return cut(kept.select("job_id"), "counted")

    if plain.similarity.enabled:
        _, failed = _halving(usages, simplified)
        if failed:
            unread = cut(reduce(DataFrame.unionByName, failed), "failed")
            failures = failures.unionByName(unread)
            usages = join_bounded(usages, unread, ["job_id"], "left_anti", written=True)
    counts, failed = _halving(usages, counted)
    failures = reduce(DataFrame.unionByName, failed, failures)
    found = reduce(DataFrame.unionByName, counts, usages.select("job_id").where(F.lit(False)))
    results = batch_results(jobs, found, failures)
    return results, batch_outcome(results)


def _halving(usages: DataFrame, run: Callable) -> tuple[list, list[DataFrame]]:
    """What ``run`` gives for groups of jobs that succeed, and ``(job_id, error)`` of jobs that fail alone."""
    done, failed = [], []
    groups: list[tuple[int, int] | None] = [None]
    while groups:
        bounds = groups.pop()
        # A range of hashes is pushed into the scan.
        group = usages if bounds is None else usages.where(F.col("_hash").between(*bounds))
        try:
            done.append(run(group))
        except AnalysisException:
            raise
        except (PySparkException, Py4JJavaError) as error:
            low, high = group.agg(F.min("_hash"), F.max("_hash")).first()
            if low is None:
                raise
            if low == high:
                failed.append(group.select("job_id").distinct().withColumn("error", F.lit(_reason(error))))
            else:
                middle = (low + high) // 2
                groups += [(low, middle), (middle + 1, high)]
    return done, failed


def _reason(error: Exception) -> str:
    """The first line of the innermost message of an error."""
    inner = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while inner is not None and inner.getCause() is not None:
        inner = inner.getCause()
    text = str(inner.getMessage() if inner is not None else error).strip()
    return text.split("\n")[0]


def analyze_incremental(
    jobs: DataFrame,
    tables: Tables,
    source_state: DataFrame,
    root: str,
    options: AnalysisOptions = AnalysisOptions(),
    symbol: bool = False,
) -> Analysis:
    """As the two analyses above, reusing results stored under ``root``.

    Only forced, unknown and outdated jobs (``jobs`` has ``force_refresh``) enter
    the plan, and their results are stored; the others are read from the store. A
    job whose solution has no known source state is computed and not stored.
    """
    started = time.time()
    named = jobs
    assemblies = None
    if symbol:
        named = jobs.withColumn("package", F.col("target")).withColumn("version", F.lit("symbol"))
    else:
        assemblies = _job_assemblies(jobs, tables, options)
    keyed = cut(fingerprint(named, source_state, options, assemblies), "jobs")
    run, reuse = split_jobs(keyed, stored_headers(jobs.sparkSession, root))
    run = cut(run, "run")
    fresh = (analyze_symbol if symbol else analyze_package)(run, tables, options)
    save_results(run, fresh.usages, root)
    # What was computed is written already; what is read from the store may go from there before it is read again.
    stored = cut(load_results(jobs.sparkSession, root, reuse).select(*USAGE_COLUMNS), "reused")
    return _analysis(keyed, fresh.usages.unionByName(stored), tables, started, symbol)


def analyze_changes(jobs: DataFrame, tables: Tables, root: str, batch: str, strict_paths: bool = False) -> ChangeStore:
    """Bring the usages stored below ``root`` up to date with ``tables.files``, reading changed files only.

    The files are compared with their state at the last update, by content. References
    of files that were added or changed are matched; what is stored of changed and removed files no
    longer holds. The store then answers for all files, with counts kept by
    addition. It holds usages before near-duplicate removal, which looks at
    whole jobs, and answers one set of jobs: if these, or what their packages are resolved to,
    change, the store must be started anew. A ``batch`` that is done already is not done again.
    """
    if tables.files is None or tables.reference_paths is None or tables.package_assemblies is None:
        raise ValueError("changes need source files, reference paths and package assemblies")
    store = ChangeStore(jobs.sparkSession, root)
    if store.committed(batch):
        return store
    wanted = cut(_job_assemblies(jobs, tables, AnalysisOptions(strict_paths=strict_paths)), "wanted")
    asks = question(wanted)
    if store.asked() not in (None, asks):
        raise ValueError("the store answers other jobs; start a new one")
    generation = store.next_generation()
    state = snapshot(tables.files, into=store.place("files", generation))
    diff = cut(snapshot_diff(store.state(), state), "file-changes")
    touched = cut(diff.where("change <> 'removed'").select("solution", "file_path"), "touched-files")
    refs = expand_nodes(tables.refs)
    if fits_broadcast(wanted):
        # References that no job asks for do not move to the files.
        refs = of_assemblies(refs.where(is_usage()), wanted)
    matched = match_assembly(of_files(refs, touched), wanted)
    store.update(batch, asks, diff, state, to_usages(matched), generation)
    return store
