"""Package tables: declared references and package content listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.functions.paths import file_stem
from refscope.runtime import cut, join_bounded

# Elements and attributes of package manifests, and the files that hold for all folders below them.
REFERENCE, CENTRAL_VERSION = "PackageReference", "PackageVersion"
ATTRIBUTES = (
    "_Include string, _Update string, _Remove string, _Version string, _VersionOverride string, Version string, VersionOverride string"
)
PROPERTY_FILES = {
    "directory.packages.props": "central",
    "directory.build.props": "shared",
    "directory.build.targets": "shared",
}
_XML = {"attributePrefix": "_", "ignoreNamespace": "true", "mode": "PERMISSIVE"}


def package_references(manifests: DataFrame, text: str = "text", pattern: str | None = None) -> DataFrame:
    """One row per package that a manifest includes, or per match of a ``pattern``; other columns are kept."""
    keys = [c for c in manifests.columns if c != text]
    if pattern is None:
        return declared_packages(manifests, text).select(*keys, "package").distinct()
    names = F.regexp_extract_all(F.col(text), F.lit(pattern), 1)
    return manifests.select(*keys, F.explode(F.array_distinct(names)).alias("package"))


def _whole_elements(text: Column, name: str) -> Column:
    """All elements of a name as they stand, with what they hold; those in comments are none."""
    attributes = """(?:[^>"'/]|/(?!>)|"[^"]*"|'[^']*')*+"""
    element = rf"(?s)<{name}(?=[\s/>]){attributes}(?:/>|>.*?</{name}\s*>)"
    bare = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)", "")
    return F.regexp_extract_all(bare, F.lit(element), 0)


def package_elements(manifests: DataFrame, text: str = "text", name: str = REFERENCE) -> DataFrame:
    """One row per package that an element of a manifest names: ``action, package, version, override``.

    ``action`` is ``include``, ``update`` or ``remove``. An element may name several
    packages with semicolons; its version is an attribute or an element inside it,
    null if there is none. Other columns are kept. An element that is no XML, and a null text, name nothing.
    """
    keys = [c for c in manifests.columns if c != text]
    found = manifests.select(*keys, F.explode(_whole_elements(F.col(text), name)).alias("_element"))
    found = found.select(*keys, F.from_xml("_element", ATTRIBUTES, _XML).alias("_e"))
    actions = F.array(
        *[F.struct(F.lit(action).alias("action"), F.col(f"_e._{action.title()}").alias("names")) for action in ("include", "update", "remove")]
    )
    given = F.nullif(F.trim(F.coalesce("_e._Version", "_e.Version")), F.lit(""))
    override = F.nullif(F.trim(F.coalesce("_e._VersionOverride", "_e.VersionOverride")), F.lit(""))
    found = found.select(*keys, F.explode(actions).alias("_a"), given.alias("version"), override.alias("override"))
    found = found.select(*keys, "_a.action", F.explode(F.split("_a.names", ";")).alias("_n"), "version", "override")
    return found.select(*keys, "action", F.trim("_n").alias("package"), "version", "override").where("package <> ''")


def declared_packages(manifests: DataFrame, text: str = "text") -> DataFrame:
    """Packages that manifests include, with the declared ``version`` (empty if none), each pair once per manifest row.

    Each manifest is taken by itself; ``declared_tree`` follows what holds for its folder.
    """
    keys = [c for c in manifests.columns if c != text]
    found = package_elements(manifests, text).where("action = 'include'")
    return found.select(*keys, "package", F.coalesce("override", "version", F.lit("")).alias("version")).distinct()


def declared_tree(manifests: DataFrame) -> DataFrame:
    """What projects declare, with what they inherit: ``(solution, project_name, file_path, package, version, origin)``.

    ``manifests(solution, project_name, file_path, text)`` holds project files and the
    property files of their folders. Of each kind of property file the nearest one at
    or above a project's folder holds for it: a shared file includes, updates or removes
    packages, a central one gives versions. A project removes what is shared, and
    updates versions. A version is the project's override, else its update, else what it includes,
    else what is shared, else central, else empty. ``origin`` is ``own`` or ``shared``. Names of packages
    are compared ignoring case; a project with several versions of a package has a row for each.

    Only distinct folders meet property files, by name, so a property file that
    holds for many projects is looked up once a folder.
    """
    name = F.lower(F.regexp_extract("file_path", r"([^/]*)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in PROPERTY_FILES.items() for x in pair])
    rows = manifests.select(
        "solution",
        "project_name",
        "file_path",
        F.regexp_extract("file_path", r"(?s)^(.*)/[^/]*$", 1).alias("folder"),
        F.coalesce(kinds[name], F.lit("project")).alias("kind"),
        name.alias("file"),
        "text",
    )
    rows = cut(rows, "manifests")
    projects, properties = rows.where("kind = 'project'"), rows.where("kind <> 'project'")

    # For every project folder the nearest file of each name.
    steps = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(steps))
    above = F.transform(
        F.sequence(F.lit(0), depth),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("from_folder")),
    )
    folders = projects.select("solution", "folder").distinct().select("solution", "folder", F.explode(above).alias("a"))
    places = cut(properties.select("solution", F.col("folder").alias("from_folder"), "file").distinct(), "property-files")
    near = join_bounded(folders.select("solution", "folder", "a.*"), places, ["solution", "from_folder"], written=True)
    near = near.groupBy("solution", "folder", "file").agg(F.max(F.struct("depth", "from_folder")).alias("n"))
    near = cut(near.select("solution", "folder", "file", "n.from_folder"), "nearest-files")

    def inherited(kind: str, element: str) -> DataFrame:
        given = package_elements(properties.where(F.col("kind") == kind).select("solution", "folder", "file", "text"), name=element)
        given = given.withColumnRenamed("folder", "from_folder").withColumn("id", F.lower("package"))
        return cut(given, f"{kind}-elements").join(near, ["solution", "from_folder", "file"])

    def first_of(action: str, value: str = "version") -> Column:
        return F.max(F.when(F.col("action") == action, F.col(value)))

    def any_of(action: str) -> Column:
        return F.max(F.col("action") == action)

    shared = inherited("shared", REFERENCE).groupBy("solution", "folder", "id").agg(
        F.min("package").alias("shared_name"),
        F.coalesce(first_of("update"), F.max("override"), first_of("include")).alias("shared_version"),
        (any_of("include") & ~any_of("remove")).alias("is_shared"),
    )
    central = inherited("central", CENTRAL_VERSION).where("action <> 'remove'").groupBy("solution", "folder", "id")
    central = central.agg(F.coalesce(first_of("update"), first_of("include")).alias("central_version"))

    place = ["solution", "project_name", "file_path", "folder"]
    own = package_elements(projects.select(*place, "text")).groupBy(*place, F.lower("package").alias("id")).agg(
        F.min("package").alias("own_name"),
        F.collect_set(F.when(F.col("action") == "include", F.coalesce("override", "version", F.lit("")))).alias("versions"),
        F.coalesce(F.max(F.when(F.col("action") == "update", F.coalesce("override", "version")))).alias("updated"),
        any_of("include").alias("is_own"),
        any_of("remove").alias("is_removed"),
    )
    # A project without any element of its own inherits as well.
    offered = projects.select(*place).distinct().join(shared.where("is_shared"), ["solution", "folder"])
    both = own.join(offered, [*place, "id"], "full")
    both = both.where("coalesce(is_own, false) OR (coalesce(is_shared, false) AND NOT coalesce(is_removed, false))")
    both = both.join(central, ["solution", "folder", "id"], "left")
    inherits = F.coalesce("shared_version", "central_version", F.lit(""))
    versions = F.when(F.col("updated").isNotNull(), F.array("updated")).when(
        F.col("is_own"), F.transform("versions", lambda v: F.when(v == "", inherits).otherwise(v))
    ).otherwise(F.array(inherits))
    return both.select(
        *place[:3],
        F.coalesce("own_name", "shared_name").alias("package"),
        F.explode(F.array_distinct(versions)).alias("version"),
        F.when(F.col("is_own"), "own").otherwise("shared").alias("origin"),
    )


def read_package_files(spark: SparkSession, root: str) -> DataFrame:
    """``package_files(package, version, path, from_archive)`` of a folder of unpacked packages.

    Only the listing is used; file contents are pruned from the scan. A package
    version that keeps its archive at its top counts as read from it.
    """
    paths = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(F.substring_index("path", root.rstrip("/") + "/", -1).alias("inside"))
    )
    parts = F.split("inside", "/")
    files = paths.where(F.size(parts) >= 3).select(
        parts[0].alias("package"),
        parts[1].alias("version"),
        F.array_join(F.slice(parts, 3, F.size(parts)), "/").alias("path"),
    )
    archive = F.col("path").rlike(r"(?i)^[^/]*\.nupkg$")
    kept = files.where(archive).select("package", "version", F.lit(True).alias("archived")).distinct()
    return files.join(kept, ["package", "version"], "left").select(
        "package", "version", "path", F.coalesce("archived", F.lit(False)).alias("from_archive")
    )


def assemblies_from_listing(files: DataFrame) -> DataFrame:
    """``package_assemblies(package, version, assembly_lc)``, distinct ignoring case.

    Archive listings count ``lib`` and ``ref`` items, plain folders ``lib`` only.
    Package and version are compared in lower case.
    """
    from_archive = F.col("from_archive") if "from_archive" in files.columns else F.lit(True)
    folder = F.when(from_archive, F.col("path").rlike(r"(?i)^(lib|ref)/")).otherwise(F.col("path").startswith("lib/"))
    return (
        files.where(folder & F.lower("path").endswith(".dll"))
        .select(
            F.lower("package").alias("package"),
            F.lower("version").alias("version"),
            F.lower(file_stem(F.col("path"))).alias("assembly_lc"),
        )
        .distinct()
    )
