"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contract.views import view
from refscope.config import (
    COMMENTS_FIRST_SIMILARITY,
    SHIPPED_SIMILARITY,
    SHIPPED_USAGE_TYPES,
    AnalysisOptions,
    Comparison,
    SimilarityConfig,
    Simplifier,
)
from refscope.functions.distance import are_similar, register_comparison
from refscope.functions.text import normalize_whitespace, register_simplifier, remove_comments, simplify
from refscope.operators import audit, context, dedup, incremental, match, refs, reports, resolve
from refscope.operators import snapshot as snapshots
from refscope.plans.analyze import Analysis, Tables, analyze_batch, analyze_changes, analyze_declared, analyze_incremental, analyze_isolated, analyze_package, analyze_symbol
from refscope.runtime import cut, own_folder
from refscope.sources import files, jobs, packages, results

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

OPTIONS = AnalysisOptions(
    context_lines=1, similarity=COMMENTS_FIRST_SIMILARITY, configured_usage_types=SHIPPED_USAGE_TYPES
)

# The comparison's own default: 10 edits or a ratio of 0.8.
DEFAULT_RULE = SimilarityConfig(True, COMMENTS_FIRST_SIMILARITY.simplifiers, (Comparison(),))

# The manifest checks of the test pages: three on content, two on the address.
PAGE_RULES = [
    audit.Rule("Ad", audit.MANIFEST, "file", "shows an ad", "<!-- ad [0-3]"),
    audit.Rule("Script", audit.MANIFEST, "file", "runs a script", "(?i)<SCRIPT"),
    audit.Rule("Link", audit.MANIFEST, "line", pattern='(?i)<a [^>]*href="[^"]*(er|tion)[^"]*"'),
    audit.Rule("T4", r"\.tt$", "name", "template present"),
    audit.Rule("InstallScript", r"(?i)^(install|init)\.ps1$", "name", "install script present"),
]


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_assembly(view(spark, sf, "symbol_refs"), view(spark, sf, "job_sets"))


def _usages(spark: SparkSession, sf: str) -> DataFrame:
    """Usages of every package job by its own assembly."""
    return refs.to_usages(_matched(spark, sf))


def _solution_usages(spark: SparkSession, sf: str) -> DataFrame:
    """All usages, one job per solution."""
    return refs.to_usages(view(spark, sf, "symbol_refs").withColumn("job_id", F.col("solution")))


def _stored(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A derived input as the written table it would be in use."""
    return cut(view(spark, sf, name), name)


def _tables(spark: SparkSession, sf: str) -> Tables:
    return Tables(
        refs=view(spark, sf, "symbol_refs"),
        projects=view(spark, sf, "projects"),
        reference_paths=_stored(spark, sf, "reference_paths"),
        package_assemblies=packages.assemblies_from_listing(view(spark, sf, "package_files")),
        files=view(spark, sf, "ref_files"),
        project_errors=view(spark, sf, "project_errors"),
    )


def _job_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usages, projects, errors) of the package jobs, straight from the tables."""
    wanted = view(spark, sf, "jobs").select("job_id", "solution")
    projects = wanted.join(view(spark, sf, "projects"), "solution").select("job_id", "project_name")
    failed = wanted.join(view(spark, sf, "project_errors"), "solution")
    errors = failed.select("job_id", reports.error_message(F.col("project_name"), F.col("error")).alias("error"))
    return cut(_usages(spark, sf), "usages"), projects, errors


# --- sources --------------------------------------------------------------------


@query
def drop_binary(spark, sf):
    return files.drop_binary_files(view(spark, sf, "source_files")).select("project_name", "file_path")


@query
def source_lines(spark, sf):
    return files.explode_lines(view(spark, sf, "source_files")).select("file_path", "line_no", "line")


@query
def batch_jobs(spark, sf):
    customer = view(spark, sf, "customer")
    even = F.concat(
        F.lit('{"jobs":[{"solutionPath":"'), "c_name", F.lit('","packageName":"'), "c_mktsegment",
        F.lit('","packageVersion":"'), (F.col("c_custkey") % 5).cast("string"),
        F.lit('.0","forceRefresh":'), (F.col("c_custkey") % 3 == 0).cast("string"), F.lit("}]}"),
    )
    odd = F.concat(
        F.lit('{"Jobs":[{"SolutionPath":"'), "c_name", F.lit('","PackageName":"'), "c_mktsegment",
        F.lit('","PackageVersion":"1"},{"SolutionPath":"'), "c_name",
        F.lit('","PackageName":"Other","PackageVersion":"2","ForceRefresh":true}]}'),
    )
    documents = customer.select(F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd).alias("value"))
    return jobs.with_job_ids(jobs.parse_jobs(documents))


@query
def declared_refs(spark, sf):
    return packages.package_references(
        view(spark, sf, "pages").select("page_id", "html"), "html", r'href="([^"]*)"'
    )


@query
def package_assemblies(spark, sf):
    return packages.assemblies_from_listing(view(spark, sf, "package_files"))


@query
def project_inventory(spark, sf):
    return files.project_inventory(view(spark, sf, "source_files"))


def _saved(spark, sf, chosen: str = "true") -> tuple[DataFrame, str]:
    """Store the chosen package jobs' usages in a new folder; returns all keyed jobs and the folder."""
    root = own_folder(spark, "results")
    keyed = incremental.fingerprint(view(spark, sf, "jobs"), view(spark, sf, "source_state"))
    keyed = cut(keyed, "jobs")
    results.save_results(keyed.where(chosen), _usages(spark, sf), root)
    return keyed, root


@query
def save_load_results(spark, sf):
    keyed, root = _saved(spark, sf)
    wanted = keyed.where(~F.col("force_refresh"))
    return results.load_results(spark, root, wanted).select(
        "job_id", "fingerprint", "project_name", "file_path", "start_line", "usage_type", "code_text"
    )


@query
def invalidate_results(spark, sf):
    keyed, root = _saved(spark, sf)
    results.invalidate(spark, root, keyed.where(F.col("force_refresh")))
    results.compact(spark, root)
    # Counted from the rows that are left, not from the headers.
    left = results.load_results(spark, root, keyed).groupBy("fingerprint").agg(F.count("*").alias("rows_left"))
    found = results.stored_headers(spark, root).select("job_id", "fingerprint", "usage_count")
    return found.join(left, "fingerprint", "left").na.fill(0, ["rows_left"])


@query
def usage_spread_union(spark, sf):
    """Spread of each package over all solutions, merged from stored sketches; whether it is near the exact numbers."""
    keyed, root = _saved(spark, sf)
    packages_of = keyed.where(F.col("fingerprint").isNotNull()).select("job_id", "package")
    merged = reports.merged_spread(results.load_sketches(spark, root, keyed).join(packages_of, "job_id"), "package")
    names = list(reports.SPREAD)
    near = merged.select("package", F.col("usages").alias("merged"), *[F.col(c).alias(f"{c}_near") for c in names])
    exact = reports.usage_spread(_usages(spark, sf).join(packages_of, "job_id").withColumn("job_id", F.col("package")))
    exact = exact.withColumnRenamed("job_id", "package")
    within = [(F.abs(F.col(f"{c}_near") - F.col(c)) <= F.greatest(0.08 * F.col(c), F.lit(1))).alias(f"{c}_near") for c in names]
    return exact.join(near, "package").select(*exact.columns, "merged", *within)


# --- references -----------------------------------------------------------------


@query
def lexical_refs(spark, sf):
    lines = files.explode_lines(view(spark, sf, "source_files"))
    return refs.lexical_refs(lines).groupBy("file_path", "node_kind", "name").agg(F.count("*").alias("n"))


@query
def bind_imports(spark, sf):
    bound = view(spark, sf, "symbol_refs")
    chain = F.col("node_kind").isin("QualifiedName", "MemberAccess")
    lexical = bound.select(
        "solution",
        "file_path",
        F.col("start_line").alias("line_no"),
        "node_kind",
        F.when(chain, F.concat("display_name", F.lit(".Run"))).otherwise(F.col("symbol_name")).alias("name"),
    )
    imports = bound.where(F.col("node_kind") == "UsingDirective").select("solution", "file_path", "namespace")
    catalog = (
        view(spark, sf, "part")
        .groupBy(
            F.concat("p_brand", F.lit("."), "p_type").alias("namespace"),
            F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("symbol_name"),
        )
        .agg(F.min("p_brand").alias("assembly_name"))
    )
    return refs.bind_by_imports(lexical, imports, catalog).select(
        "solution", "file_path", "line_no", "node_kind", "name", "namespace", "symbol_name", "assembly_name"
    )


@query
def lexical_analysis(spark, sf):
    """Raw files to counts, without an indexer: extract, bind by imports, match symbols, count."""
    lines = files.explode_lines(view(spark, sf, "code_files"))
    found = cut(refs.lexical_refs(lines), "lexical")
    bound = refs.lexical_symbol_refs(found, view(spark, sf, "code_catalog"))
    matched = match.match_symbol(cut(bound, "bound"), view(spark, sf, "code_targets"))
    return reports.usage_by_project_type(refs.to_usages(matched))


@query
def generic_fanout(spark, sf):
    nodes = view(spark, sf, "generic_refs").withColumn(
        "type_args",
        F.array(
            F.struct(
                F.col("arg_text").alias("code_text"),
                F.col("arg_symbol").alias("symbol_name"),
                F.col("arg_namespace").alias("namespace"),
                F.col("arg_display").alias("display_name"),
                F.col("arg_assembly").alias("assembly_name"),
            )
        ),
    )
    return refs.classify_usage(refs.expand_nodes(nodes)).select(
        "project_name", "file_path", "start_line", "usage_type", "symbol_name", "assembly_name", "code_text"
    )


@query
def classify_usage(spark, sf):
    return refs.classify_usage(view(spark, sf, "symbol_refs")).select(
        "file_path", "start_line", "node_kind", "parent_kind", "symbol_kind", "symbol_name", "usage_type"
    )


@query
def match_assembly(spark, sf):
    return _matched(spark, sf).select("job_id", "project_name", "file_path", "start_line", "assembly_name", "code_text")


@query
def match_symbol(spark, sf):
    return match.match_symbol(view(spark, sf, "symbol_refs"), view(spark, sf, "targets")).select(
        "job_id", "project_name", "file_path", "start_line", "namespace", "display_name", "code_text"
    )


@query
def usage_type_filter(spark, sf):
    wanted = [*[t.upper() for t in SHIPPED_USAGE_TYPES], "NoSuchType"]
    return match.filter_usage_types(_solution_usages(spark, sf), None, wanted).select(
        "job_id", "project_name", "file_path", "start_line", "usage_type", "code_text"
    )


@query
def symbol_contains(spark, sf):
    return match.filter_symbol_name(_solution_usages(spark, sf), contains="bolt").select(
        "job_id", "file_path", "start_line", "symbol_name", "code_text"
    )


# --- joins ----------------------------------------------------------------------


@query
def assemblies_from_paths(spark, sf):
    paths, wanted = view(spark, sf, "reference_paths"), view(spark, sf, "jobs")
    wanted = cut(wanted, "jobs")
    loose = resolve.assemblies_from_paths(paths, wanted)
    strict = resolve.assemblies_from_paths(paths, wanted, strict=True)
    return loose.withColumn("strict", F.lit(False)).unionByName(strict.withColumn("strict", F.lit(True)))


@query
def resolve_assemblies(spark, sf):
    return resolve.resolve_assemblies(
        _stored(spark, sf, "jobs"),
        _stored(spark, sf, "reference_paths"),
        packages.assemblies_from_listing(view(spark, sf, "package_files")),
    )


@query
def batch_usages(spark, sf):
    return _usages(spark, sf).groupBy("job_id").agg(F.count("*").alias("usages"))


@query
def unused_packages(spark, sf):
    """From manifests to what is declared and never used."""
    _, unused = analyze_declared(view(spark, sf, "project_manifests"), _tables(spark, sf))
    return unused


@query
def declared_tree(spark, sf):
    """What projects declare in eight ways of writing, with what the folders above give."""
    return packages.declared_tree(view(spark, sf, "tree_manifests"))


# --- context --------------------------------------------------------------------


@query
def context_snippet(spark, sf):
    return _with_context(spark, sf, view(spark, sf, "source_files"))


@query
def context_chunks(spark, sf):
    """The same snippets out of a store of line chunks."""
    return _with_context(spark, sf, cut(context.chunk_lines(view(spark, sf, "source_files")), "chunks"))


def _with_context(spark, sf, texts: DataFrame) -> DataFrame:
    plain = view(spark, sf, "doc_usages").select(
        "*",
        F.lit(0).alias("context_start_line"),
        F.lit(0).alias("context_end_line"),
        F.lit(False).alias("has_context"),
    )
    return context.attach_context(plain, texts).select(
        "event_id", "file_path", "start_line", "context_start_line", "context_end_line", "has_context", "code_text"
    )


@query
def context_status(spark, sf):
    return context.snippets(view(spark, sf, "doc_usages"), view(spark, sf, "source_files")).select(
        "file_path", "start_line", "context_lines", "first_line", "last_line", "truncated", "status"
    )


@query
def context_window(spark, sf):
    return context.context_of_every_line(view(spark, sf, "source_files"), 2).select("file_path", "line_no", "content")


@query
def marked_context(spark, sf):
    usages = _solution_usages(spark, sf).withColumn("context_lines", F.lit(1))
    shown = context.attach_context(usages, view(spark, sf, "ref_files"))
    return context.marked_context(shown).select("project_name", "file_path", "start_line", "end_line", "symbol_name", "printed")


# --- text and similarity ----------------------------------------------------------


@query
def normalize_ws(spark, sf):
    code = view(spark, sf, "commented_code")
    return code.select("p_partkey", normalize_whitespace(F.col("code_text")).alias("text"))


@query
def strip_comments(spark, sf):
    code = view(spark, sf, "commented_code")
    return code.select("p_partkey", remove_comments(F.col("code_text")).alias("text"))


@query
def simplify_text(spark, sf):
    code = view(spark, sf, "commented_code")
    return code.select(
        "p_partkey",
        simplify(F.col("code_text"), SHIPPED_SIMILARITY).alias("shipped"),
        simplify(F.col("code_text"), COMMENTS_FIRST_SIMILARITY).alias("comments_first"),
    )


@query
def levenshtein_similar(spark, sf):
    pairs = view(spark, sf, "snippet_pairs")
    verdict = are_similar(F.col("code_text"), F.col("next_text"), SHIPPED_SIMILARITY)
    return pairs.select("l_orderkey", "l_linenumber", "code_text", "next_text", verdict.alias("similar"))


@query
def similar_pairs(spark, sf):
    return dedup.similar_pairs(view(spark, sf, "snippet_pairs"), "code_text", "next_text", SHIPPED_SIMILARITY)


@query
def exact_dedup(spark, sf):
    return dedup.exact_dedup(_solution_usages(spark, sf), SHIPPED_SIMILARITY).select(
        "job_id", "project_name", "file_path", "start_line", "usage_type", "code_text"
    )


@query
def near_dedup(spark, sf):
    return dedup.near_dedup(_solution_usages(spark, sf), SHIPPED_SIMILARITY).select(
        "job_id", "project_name", "file_path", "start_line", "usage_type", "code_text"
    )


@query
def near_dedup_default(spark, sf):
    """With the comparison's own default settings, on the comments-first text."""
    return dedup.near_dedup(_solution_usages(spark, sf), DEFAULT_RULE).select(
        "job_id", "project_name", "file_path", "start_line", "usage_type", "code_text"
    )


@query
def registered_plugins(spark, sf):
    """A simplifier and a comparison of the caller's own: texts without digits that are made of the same characters."""
    register_simplifier("NoDigits", lambda text: F.regexp_replace(text, "[0-9]", ""))
    made_of = lambda text: F.array_sort(F.array_distinct(F.split(text, "")))
    register_comparison("SameCharacters", lambda a, b, rule: made_of(a) == made_of(b))
    config = SimilarityConfig(True, (Simplifier("NoDigits"),), (Comparison("SameCharacters"),))
    return dedup.dedup_groups(_solution_usages(spark, sf), config)


def _unlike(spark, sf) -> DataFrame:
    """All snippets of all orders as one job: some 60 in 100 are unlike all others."""
    return view(spark, sf, "order_snippets")


@query
def near_dedup_tokens(spark, sf):
    """One job of very many unlike texts, compared by the share of their words."""
    config = SimilarityConfig(True, SHIPPED_SIMILARITY.simplifiers, (Comparison("TokenOverlapComparison", threshold=0.8),))
    return dedup.near_dedup(_unlike(spark, sf).drop("tagged"), config).select("file_path", "start_line", "end_line", "code_text")


@query
def near_dedup_unlike(spark, sf):
    """The same job by edit distance, over texts that begin with a hash of their order."""
    tagged = _unlike(spark, sf).withColumn("code_text", F.col("tagged")).drop("tagged")
    return dedup.near_dedup(tagged, SHIPPED_SIMILARITY).select("file_path", "start_line", "end_line", "code_text")


@query
def dedup_groups(spark, sf):
    return dedup.dedup_groups(_solution_usages(spark, sf), SHIPPED_SIMILARITY)


# --- counts and reports -----------------------------------------------------------


@query
def usage_by_project(spark, sf):
    return reports.usage_by_project(_usages(spark, sf))


@query
def usage_by_project_type(spark, sf):
    return reports.usage_by_project_type(_usages(spark, sf))


@query
def usage_rollup(spark, sf):
    return reports.usage_rollup(_usages(spark, sf))


@query
def summary(spark, sf):
    usages, projects, errors = _job_parts(spark, sf)
    out = reports.summary(view(spark, sf, "analyses"), usages, projects, errors)
    return out.withColumn("duration", reports.duration_text(F.col("duration_ms")))


@query
def merge_results(spark, sf):
    failed = view(spark, sf, "project_errors")
    done = _solution_usages(spark, sf).join(failed.select("solution", "project_name"), ["solution", "project_name"], "left_anti")
    failures = failed.withColumn("job_id", F.col("solution"))
    usages, projects, errors = reports.merge_results([done.withColumn("error", F.lit(None).cast("string")), failures])
    counted = [
        part.groupBy("job_id").agg(F.count("*").alias("n")).select("job_id", F.lit(kind).alias("kind"), "n")
        for kind, part in (("usages", usages), ("projects", projects))
    ]
    return (
        counted[0]
        .unionByName(counted[1])
        .unionByName(errors.select("job_id", F.col("error").alias("kind"), F.lit(1).cast("bigint").alias("n")))
    )


@query
def batch_outcome(spark, sf):
    usages, _, errors = _job_parts(spark, sf)
    return reports.batch_outcome(reports.batch_results(view(spark, sf, "jobs"), usages, errors))


@query
def usage_spread(spark, sf):
    return reports.usage_spread(_usages(spark, sf))


@query
def usage_spread_approx(spark, sf):
    """Exact numbers, and whether each estimate lies within five times its stated error."""
    usages = cut(_usages(spark, sf), "usages")
    exact, names = reports.usage_spread(usages), ["files", "projects", "symbols"]
    near = reports.usage_spread_approx(usages).select("job_id", *[F.col(c).alias(f"{c}_near") for c in names])
    within = [(F.abs(F.col(f"{c}_near") - F.col(c)) <= F.greatest(0.1 * F.col(c), F.lit(1))).alias(f"{c}_near") for c in names]
    return exact.join(near, "job_id").select(*exact.columns, *within)


@query
def detailed_report(spark, sf):
    return reports.detailed_report(_usages(spark, sf)).select(
        "job_id", "project_name", "file_path", "start_line", "end_line", "usage_type", "symbol_name", "namespace", "code_text"
    )


def _summaries(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    usages, projects, errors = _job_parts(spark, sf)
    return reports.summary(view(spark, sf, "analyses"), usages, projects, errors), usages, projects, errors


@query
def package_report_e2e(spark, sf):
    """An analysis and its own report: all but the times, which are those of the run."""
    report = analyze_package(_stored(spark, sf, "jobs"), _tables(spark, sf)).report()
    times = r'"(analyzedAt|analysisDuration)":"[0-9TZ:.-]+",?'
    return report.withColumn("json", F.when(F.col("part") == 0, F.regexp_replace("json", times, "")).otherwise(F.col("json")))


@query
def report_json(spark, sf):
    return reports.usage_report(*_summaries(spark, sf))


@query
def report_documents(spark, sf):
    """The same reports as lines of one JSON document per job."""
    return reports.documents(reports.usage_report(*_summaries(spark, sf))).drop("copy")


@query
def result_documents(spark, sf):
    """The full results as lines of one JSON document per job."""
    return reports.documents(reports.full_result(*_summaries(spark, sf)), pascal=True).drop("copy")


def _symbol_found(spark, sf) -> Analysis:
    """Symbol jobs, with the times their solutions' analyses took."""
    started = view(spark, sf, "analyses").groupBy("solution").agg(
        F.max("analyzed_at").alias("analyzed_at"), F.max("duration_ms").alias("duration_ms")
    )
    found = analyze_symbol(view(spark, sf, "symbol_jobs").join(started, "solution"), _tables(spark, sf))
    return found


@query
def symbol_report_json(spark, sf):
    return _symbol_found(spark, sf).report()


@query
def result_json(spark, sf):
    return reports.full_result(*_summaries(spark, sf))


@query
def symbol_result_json(spark, sf):
    return _symbol_found(spark, sf).result()


@query
def error_report(spark, sf):
    failed = view(spark, sf, "analyses").join(view(spark, sf, "project_errors"), "solution")
    return reports.error_report(failed.withColumn("failed_at", F.col("analyzed_at")))


# --- incremental ------------------------------------------------------------------


@query
def fingerprint(spark, sf):
    wanted, state = view(spark, sf, "jobs"), view(spark, sf, "source_state")
    plain = incremental.fingerprint(wanted, state).select("job_id", "fingerprint")
    filtered = incremental.fingerprint(wanted, state, OPTIONS).select("job_id", F.col("fingerprint").alias("with_settings"))
    return plain.join(filtered, "job_id")


@query
def jobs_to_run(spark, sf):
    """After a first run of the jobs marked for refresh: the marks are turned, and all jobs are asked for."""
    keyed, root = _saved(spark, sf, "force_refresh")
    again = keyed.withColumn("force_refresh", ~F.col("force_refresh"))
    run, reuse = incremental.split_jobs(again, results.stored_headers(spark, root))
    return (
        run.withColumn("action", F.lit("run"))
        .unionByName(reuse.withColumn("action", F.lit("reuse")))
        .select("job_id", "action")
    )


@query
def changed_files(spark, sf):
    """Files of orders, stored when ordered, changed when a later item was shipped."""
    path = lambda key: F.concat(F.lit("src/"), F.col(key).cast("string"), F.lit(".cs")).alias("file_path")
    solution = F.lit("orders").alias("solution")
    shipped = view(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("mtime"))
    stored = view(spark, sf, "orders").select(solution, path("o_orderkey"), F.col("o_orderdate").alias("mtime"))
    return incremental.changed_files(shipped.select(solution, path("l_orderkey"), "mtime"), cut(stored, "file-state"))


@query
def snapshot_diff(spark, sf):
    """Files added, changed and removed, by the digest trees of two snapshots."""
    before, after = (snapshots.snapshot(view(spark, sf, name)) for name in ("files_before", "files_after"))
    return snapshots.snapshot_diff(before, after)


@query
def delta_analysis(spark, sf):
    """A first run over all files, a second over the changed ones; counts by signed addition."""
    root = own_folder(spark, "changes")
    wanted, tables = _stored(spark, sf, "jobs"), _tables(spark, sf)
    for name in ("before", "after"):
        tables = replace(tables, refs=view(spark, sf, f"refs_{name}"), files=view(spark, sf, f"ref_files_{name}"))
        store = analyze_changes(wanted, tables, root, name)
    merged = store.usages().groupBy("job_id", "project_name", "usage_type").agg(F.count(F.lit(1)).alias("merged"))
    counted = store.counts().select("job_id", "project_name", "usage_type", "n")
    return counted.join(merged, ["job_id", "project_name", "usage_type"], "full")


# --- audits -----------------------------------------------------------------------


@query
def rule_scan(spark, sf):
    return audit.rule_scan(view(spark, sf, "manifests"), PAGE_RULES)


@query
def scan_summary(spark, sf):
    manifests = view(spark, sf, "manifests")
    return audit.scan_summary(manifests, audit.rule_scan(manifests, PAGE_RULES))


@query
def expectations(spark, sf):
    expected = spark.sql(
        "SELECT * FROM (VALUES ('Brand#1.ECONOMY', 1, 1000000), ('Brand#2.SMALL', 0, 3), ('Nowhere', 0, 0), ('Nobody', 1, 5))"
        " v(check_name, lo, hi)"
    )
    counts = (
        view(spark, sf, "symbol_refs").groupBy(F.col("namespace").alias("check_name")).agg(F.count("*").alias("n"))
    )
    return audit.check_expectations(expected, counts)


# --- whole analyses ---------------------------------------------------------------


def _rows(found: Analysis) -> DataFrame:
    return found.usages.select(
        "job_id", "project_name", "file_path", "start_line", "usage_type", "symbol_name", "code_text",
        "context_start_line", "context_end_line", "has_context",
    )


@query
def package_analysis(spark, sf):
    return _rows(analyze_package(_stored(spark, sf, "jobs"), _tables(spark, sf), OPTIONS))


@query
def symbol_analysis(spark, sf):
    return _rows(analyze_symbol(view(spark, sf, "symbol_jobs"), _tables(spark, sf), OPTIONS))


def _batch(spark, sf) -> DataFrame:
    """The package jobs and, as jobs that must fail, market segments taken for solutions."""
    wanted = _stored(spark, sf, "jobs")
    unknown = (
        view(spark, sf, "customer")
        .select(F.col("c_mktsegment").alias("solution"))
        .distinct()
        .select(
            F.concat("solution", F.lit("|none")).alias("job_id"), "solution",
            F.lit("none").alias("package"), F.lit("1.0").alias("version"), F.lit(False).alias("force_refresh"),
        )
    )
    return wanted.unionByName(unknown)


@query
def batch_analysis(spark, sf):
    rows, _ = analyze_batch(_batch(spark, sf), _tables(spark, sf), OPTIONS)
    return rows.select("job_id", "success", "error", "usage_count")


@query
def batch_isolated(spark, sf):
    """The same batch with a simplifier that raises on the texts of the last file: its jobs fail, the others do not."""
    tables, reject = _tables(spark, sf), "text is not readable"
    last = tables.refs.select(F.max("file_path")).scalar()
    marked = F.when(F.col("file_path") == last, F.concat(F.lit("\f"), "code_text")).otherwise(F.col("code_text"))
    register_simplifier("Readable", lambda text: F.when(text.startswith("\f"), F.raise_error(F.lit(reject))).otherwise(text))
    steps = (Simplifier("Readable", priority=0), *COMMENTS_FIRST_SIMILARITY.simplifiers)
    options = replace(OPTIONS, similarity=replace(COMMENTS_FIRST_SIMILARITY, simplifiers=steps))
    tables = replace(tables, refs=tables.refs.withColumn("code_text", marked))
    rows, _ = analyze_isolated(_batch(spark, sf), tables, options)
    error = F.when(F.col("error").contains(reject), reject).otherwise(F.col("error"))
    return rows.select("job_id", "success", error.alias("error"), "usage_count")


@query
def incremental_analysis(spark, sf):
    """A first run answers the jobs marked for refresh, a second run all jobs and reuses what it may."""
    root = own_folder(spark, "results")
    wanted, tables, state = _stored(spark, sf, "jobs"), _tables(spark, sf), _stored(spark, sf, "source_state")
    analyze_incremental(wanted.where(F.col("force_refresh")), tables, state, root)
    again = wanted.withColumn("force_refresh", ~F.col("force_refresh"))
    found = analyze_incremental(again, tables, state, root)
    return found.summary().select("job_id", "total_usage_count", "analyzed_project_count", "error_count")
