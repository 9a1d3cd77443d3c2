"""Which references belong to which job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.runtime import join_bounded
from refscope.schemas import USAGE_TYPES


def match_assembly(refs: DataFrame, job_assemblies: DataFrame) -> DataFrame:
    """References whose assembly is in the job's set, ignoring case; adds ``job_id``.

    ``job_assemblies(job_id, solution, assembly_lc)``. A null assembly matches nothing.
    """
    wanted = job_assemblies.select("job_id", "solution", "assembly_lc").distinct()
    keyed = refs.withColumn("assembly_lc", F.lower("assembly_name"))
    return join_bounded(keyed, wanted, ["solution", "assembly_lc"]).drop("assembly_lc")


def of_assemblies(refs: DataFrame, wanted: DataFrame) -> DataFrame:
    """References that some job of ``wanted``, a small written table, matches; the others go where they are read."""
    keyed = refs.withColumn("assembly_lc", F.lower("assembly_name"))
    return join_bounded(keyed, wanted, ["solution", "assembly_lc"], "left_semi", written=True).drop("assembly_lc")


def _symbol_keys(match_member: bool) -> Column:
    """Every key under which a target can reach this symbol.

    ``x`` keys are compared as written; ``p`` keys are the lower-cased proper
    dotted prefixes of the namespace, so ``A.B`` reaches ``a.b.c`` but not ``A.Bc``.
    """

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("key"))

    parts = F.split(F.lower("namespace"), r"\.")
    prefixes = F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda n: key("p", F.array_join(F.slice(parts, 1, n), ".")),
        ),
    ).otherwise(F.filter(F.array(key("p", F.lit(""))), lambda _: F.lit(False)))
    exact = [key("x", F.col("namespace")), key("x", F.col("display_name"))]
    if match_member:
        exact.append(key("x", F.regexp_replace("display_name", r"\(.*$", "")))
    return F.array_distinct(F.concat(F.array(*exact), F.coalesce(prefixes, F.array().cast("array<struct<kind:string,key:string>>"))))


def match_symbol(refs: DataFrame, targets: DataFrame, match_member: bool = False) -> DataFrame:
    """References matched by a symbol target; adds ``job_id``, at most once per job and reference.

    ``targets(job_id[, solution], target)``. The rule (namespace equal, full name
    equal, or namespace below the target ignoring case) becomes a set of equality
    keys per distinct symbol, so it runs as hash joins and never as a nested loop.
    """
    scoped = [c for c in ("solution",) if c in targets.columns]
    symbol = ["namespace", "display_name"]
    symbols = refs.select(*scoped, *symbol).distinct()
    reachable = symbols.select(*scoped, *symbol, F.explode(_symbol_keys(match_member)).alias("k")).select(
        *scoped, *symbol, "k.kind", "k.key"
    )
    wanted = targets.select(
        "job_id",
        *scoped,
        F.explode(
            F.array(
                F.struct(F.lit("x").alias("kind"), F.col("target").alias("key")),
                F.struct(F.lit("p").alias("kind"), F.lower("target").alias("key")),
            )
        ).alias("k"),
    ).select("job_id", *scoped, "k.kind", "k.key")
    hits = join_bounded(reachable, wanted, [*scoped, "kind", "key"]).select("job_id", *scoped, *symbol).distinct()
    # Null names join as values of their own.
    missing = {"_ns": "namespace", "_name": "display_name"}
    named = {key: F.coalesce(column, F.lit("\u0000")) for key, column in missing.items()}
    marked = hits.withColumns(named).drop(*symbol)
    return join_bounded(refs.withColumns(named), marked, [*scoped, *missing]).drop(*missing)


def parse_usage_types(names: list[str] | None) -> list[str]:
    """Known names in declared spelling, case ignored; unknown ones are skipped.

    A number stands for its position in the declared list.
    """
    by_name = {t.lower(): t for t in USAGE_TYPES}
    out = []
    for raw in names or []:
        name = raw.strip().lower()
        if name.isdigit():
            out.append(USAGE_TYPES[int(name)] if int(name) < len(USAGE_TYPES) else name)
        elif name in by_name:
            out.append(by_name[name])
    return out


def filter_usage_types(
    usages: DataFrame, explicit: list[str] | None = None, configured: list[str] | None = None
) -> DataFrame:
    """Keep the wanted usage types. Explicit names win; none at all keeps everything."""
    wanted = parse_usage_types(explicit if explicit is not None else configured)
    return usages.where(F.col("usage_type").isin(wanted)) if wanted else usages


def filter_symbol_name(usages: DataFrame, exact: str | None = None, contains: str | None = None) -> DataFrame:
    """Keep usages by symbol name; both tests are case-sensitive."""
    out = usages
    if exact is not None:
        out = out.where(F.col("symbol_name") == exact)
    if contains is not None:
        out = out.where(F.col("symbol_name").contains(contains))
    return out
