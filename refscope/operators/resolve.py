"""Which assemblies a package stands for: compiled paths, else its listing, else its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refscope.functions.paths import file_stem
from refscope.runtime import cut, join_bounded

# Lengths of the text windows used to look names up inside paths.
ANCHOR_SIZES = [16, 8, 4, 2, 1]


def _windows(text: Column, size: Column) -> Column:
    """All distinct substrings of one length; none if the text is shorter."""
    starts = F.sequence(F.lit(1), F.char_length(text) - size + 1)
    return F.when(
        F.char_length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))
    )


def names_inside_paths(paths: DataFrame, names: DataFrame) -> DataFrame:
    """``(path_lc, name_lc)`` wherever the path contains the name; no nested loop.

    Each name is looked up by one of its windows: of those with the largest
    anchor size that fits, the one found in the fewest paths. Every path offers
    all its windows, so the join finds each path that could hold the name, and
    the final test makes it exact.
    """
    size = F.lit(ANCHOR_SIZES[-1])
    for s in reversed(ANCHOR_SIZES):
        size = F.when(F.char_length("name_lc") >= s, F.lit(s)).otherwise(size)
    sized = cut(names.where(F.col("name_lc") != "").select("name_lc", size.alias("size")).distinct(), "names")
    name_windows = sized.select("name_lc", F.explode(_windows(F.col("name_lc"), F.col("size"))).alias("gram"))
    # At most one value for each anchor size: paths offer windows of the sizes that are asked for.
    used = sorted(r["size"] for r in sized.select("size").distinct().collect())
    path_windows = (
        paths.select("path_lc")
        .distinct()
        .select("path_lc", F.explode(F.lit(used) if used else F.array().cast("array<int>")).alias("size"))
        .select("path_lc", F.explode(_windows(F.col("path_lc"), F.col("size"))).alias("gram"))
    )
    # Only windows that occur in some name can lead anywhere.
    sought = name_windows.select("gram").distinct()
    path_windows = cut(join_bounded(path_windows, sought, ["gram"], "left_semi"), "windows")
    frequency = path_windows.groupBy("gram").agg(F.count("*").alias("paths"))
    anchors = (
        name_windows.join(frequency, "gram")
        .groupBy("name_lc")
        .agg(F.min(F.struct("paths", "gram")).alias("rarest"))
        .select("name_lc", F.col("rarest.gram").alias("gram"))
    )
    return (
        join_bounded(path_windows, anchors, ["gram"])
        .where(F.col("path_lc").contains(F.col("name_lc")))
        .select("path_lc", "name_lc")
    )


def assemblies_from_paths(reference_paths: DataFrame, packages: DataFrame, strict: bool = False) -> DataFrame:
    """Tier 1, ``(solution, package, assembly_lc)``.

    A reference path belongs to a package if it contains the package name and
    the word ``packages``, ignoring case; so ``X`` also catches ``X.Bson``.
    ``strict`` asks for a whole path segment instead.
    """
    paths = (
        reference_paths.select("solution", "path", F.lower("path").alias("path_lc"))
        .where(F.col("path_lc").contains("packages"))
        .distinct()
    )
    names = packages.select("package", F.lower("package").alias("name_lc")).distinct()
    if strict:
        pairs = paths.select("path_lc", F.explode(F.array_distinct(F.split("path_lc", r"[/\\\\]"))).alias("name_lc"))
        pairs = pairs.distinct().join(names.select("name_lc").distinct(), "name_lc", "left_semi")
    else:
        pairs = names_inside_paths(paths, names)
    return (
        paths.join(pairs, "path_lc")
        .join(names, "name_lc")
        .select("solution", "package", F.lower(file_stem(F.col("path"))).alias("assembly_lc"))
        .distinct()
    )


def resolve_assemblies(
    jobs: DataFrame, reference_paths: DataFrame, package_assemblies: DataFrame, strict: bool = False
) -> DataFrame:
    """``(solution, package, version, assembly_lc, tier)``: the first tier that has any assembly.

    Resolved once per distinct (solution, package, version) of the jobs.
    """
    key = ["solution", "package", "version"]
    wanted = jobs.select(*key).distinct()
    from_paths = wanted.join(
        assemblies_from_paths(reference_paths, wanted, strict), ["solution", "package"]
    ).select(*key, "assembly_lc", F.lit(1).alias("tier"))
    listed = package_assemblies.select(
        F.col("package").alias("package_lc"), F.col("version").alias("version_lc"), "assembly_lc"
    )
    from_listing = (
        wanted.withColumn("package_lc", F.lower("package"))
        .withColumn("version_lc", F.lower("version"))
        .join(listed, ["package_lc", "version_lc"])
        .select(*key, "assembly_lc", F.lit(2).alias("tier"))
    )
    by_name = wanted.select(*key, F.lower("package").alias("assembly_lc"), F.lit(3).alias("tier"))
    tiers = from_paths.unionByName(from_listing).unionByName(by_name)
    best = F.min("tier").over(Window.partitionBy(*key))
    return tiers.withColumn("best", best).where(F.col("tier") == F.col("best")).drop("best")


def job_assemblies(jobs: DataFrame, resolved: DataFrame) -> DataFrame:
    """``(job_id, solution, assembly_lc, tier)`` for every job."""
    return jobs.select("job_id", "solution", "package", "version").join(
        resolved, ["solution", "package", "version"]
    ).select("job_id", "solution", "assembly_lc", "tier")
