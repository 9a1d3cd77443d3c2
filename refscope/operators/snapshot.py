"""Digest trees of source snapshots: whether a solution changed, and where.

A file's digest covers its path and its content. A folder's digest is the sum
of the digests of all files below it, so it does not depend on any order, and
a removed, renamed or restored file changes it as an edited one does. Two
snapshots are compared from the root: a folder of equal digests is not looked
into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.runtime import cut, join_bounded

# A digest is added up in four parts of 32 bits, as longs: exact for 2**31 files.
PARTS = 4
_SUMS = [f"d{i}" for i in range(PARTS)]
_MODULUS = 1 << 32


@dataclass
class Snapshot:
    """State of solutions at one time.

    ``files(solution, file_path, folder, digest)``, the digest as 16 bytes; ``folders(solution, folder,
    parent, depth, files, own, digest)`` with ``files`` the number of files below,
    ``own`` the digest of the files directly inside, and ``digest`` that of all below.
    The folder of depth 0 has the empty name and stands for the solution.
    """

    files: DataFrame
    folders: DataFrame


def file_digest(path: Column, *content: Column) -> Column:
    """128 bits of a path and what the file holds, as hex; null content differs from empty."""
    told = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in content]
    return F.md5(F.concat_ws("\0", path, *told))


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def digest_parts(digest: Column) -> list[Column]:
    """A digest's four parts as whole numbers, for adding up."""
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"d{i}") for i in range(PARTS)]


def digest_sums() -> list[Column]:
    """Aggregates that add up the parts."""
    return [F.pmod(F.sum(c), F.lit(_MODULUS)).alias(c) for c in _SUMS]


def digest_text(columns: list[str] = _SUMS) -> Column:
    """The digest of added-up parts, as hex."""
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 8, "0") for c in columns])


def snapshot(files: DataFrame, content: str = "text", into: str | None = None) -> Snapshot:
    """The digest tree of ``files(solution, file_path, <content>)``.

    ``content`` is what tells versions of a file apart: its text, or, where texts are
    not at hand, a time or hash of them. A path given twice counts twice. Files are
    added up by folder first; only folders are then spread over their ancestors. The files are written
    to the new folder ``into``, if given, and kept there; else as a cut.
    """
    digest = file_digest(F.col("file_path"), F.col(content))
    rows = files.select("solution", "file_path", _folder(F.col("file_path")).alias("folder"), F.unhex(digest).alias("digest"))
    if into is None:
        rows = cut(rows, "file-digests")
    else:
        rows.write.parquet(into)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(into)
    own = rows.select("solution", "folder", *digest_parts(F.hex("digest"))).groupBy("solution", "folder")
    own = own.agg(F.count(F.lit(1)).alias("files"), *digest_sums())
    steps = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(steps))
    above = F.transform(
        F.sequence(F.lit(0), depth),
        lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("name")),
    )
    direct = [F.when(F.col("a.name") == F.col("folder"), F.col(c)).otherwise(0).alias(f"o{c}") for c in _SUMS]
    spread = own.select("*", F.explode(above).alias("a"))
    spread = spread.select("solution", F.col("a.name").alias("folder"), F.col("a.depth").alias("depth"), "files", *_SUMS, *direct)
    tree = spread.groupBy("solution", "folder", "depth").agg(
        F.sum("files").alias("files"), *digest_sums(), *[F.sum(f"o{c}").alias(f"o{c}") for c in _SUMS]
    )
    tree = tree.select(
        "solution",
        "folder",
        F.when(F.col("depth") > 0, _folder(F.col("folder"))).alias("parent"),
        "depth",
        "files",
        digest_text([f"o{c}" for c in _SUMS]).alias("own"),
        digest_text().alias("digest"),
    )
    return Snapshot(rows, cut(tree, "folder-digests"))


def source_digest(state: Snapshot) -> DataFrame:
    """``(solution, files, digest)``: what ``fingerprint`` makes part of a solution's key."""
    return state.folders.where("depth = 0").select("solution", "files", "digest")


def changed_folders(old: Snapshot, new: Snapshot) -> DataFrame:
    """``(solution, folder)``: folders whose own files differ, found from the roots down.

    Each level reads the children of those folders only that differ on the level
    above; the number of levels is the depth of the deepest change.
    """
    keys = ["solution", "folder"]

    def level(state: Snapshot, depth: int, within: DataFrame | None, name: str) -> DataFrame:
        rows = state.folders.where(F.col("depth") == depth)
        if within is not None:
            rows = join_bounded(rows, within, ["solution", "parent"], "left_semi", written=True)
        return rows.select(*keys, F.struct("own", "digest").alias(name))

    found: list[DataFrame] = []
    within: DataFrame | None = None
    depth = 0
    while True:
        both = level(old, depth, within, "was").join(level(new, depth, within, "now"), keys, "full")
        differ = both.where(~F.col("was.digest").eqNullSafe(F.col("now.digest")))
        differ = cut(differ.select(*keys, (~F.col("was.own").eqNullSafe(F.col("now.own"))).alias("own")), "changed-folders")
        if differ.isEmpty():
            break
        found.append(differ.where("own").select(*keys))
        within = differ.select("solution", F.col("folder").alias("parent"))
        within = cut(within, "changed-parents")
        depth += 1
    if not found:
        return old.folders.select(*keys).limit(0)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def snapshot_diff(old: Snapshot, new: Snapshot) -> DataFrame:
    """``(solution, file_path, change)``: files ``added``, ``changed`` or ``removed`` between two snapshots.

    Only files of folders that differ are compared. A renamed file is one removed and one added. After an empty
    snapshot all files are new: nothing is compared.
    """
    if old.folders.isEmpty():
        return new.files.select("solution", "file_path").distinct().withColumn("change", F.lit("added"))
    folders = cut(changed_folders(old, new), "changed-places")

    def inside(state: Snapshot, name: str) -> DataFrame:
        rows = join_bounded(state.files, folders, ["solution", "folder"], "left_semi", written=True)
        return rows.groupBy("solution", "file_path").agg(F.array_sort(F.collect_list("digest")).alias(name))

    both = inside(old, "was").join(inside(new, "now"), ["solution", "file_path"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select("solution", "file_path", change.alias("change")).where("change IS NOT NULL")
