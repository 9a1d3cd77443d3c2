"""Stored usages that follow changes of files: tombstones, merge on read, signed counts.

An update writes one generation: the usages of the files that were read anew,
a tombstone for each file whose older usages no longer hold, signed counts of
both, the state of the files, and last the commit that makes all of it visible.
A reader takes a file's usages from generations no older than its last
tombstone. Counts are kept by addition: nothing is recounted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.operators.snapshot import Snapshot, digest_parts, digest_sums, digest_text
from refscope.runtime import cut, fits_broadcast, marked
from refscope.schemas import USAGE_COLUMNS, USAGE_SCHEMA
from refscope.sources.results import complete, generations

FILE = ["solution", "file_path"]
COUNTED = ["job_id", "solution", "project_name", "usage_type"]
_SCHEMAS = {
    "usages": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in USAGE_SCHEMA),
    "tombstones": "solution string, file_path string",
    "counts": "job_id string, solution string, project_name string, usage_type string, n bigint",
    "files": "solution string, file_path string, folder string, digest binary",
    "folders": "solution string, folder string, parent string, depth int, files bigint, own string, digest string",
    "commits": "batch string, question string",
}
#: So many changed files are named in the scan itself, which then skips files and row groups.
NAMED_FILES = 1_000


def of_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``files(solution, file_path)``, a written table; others are skipped by the scan where the files are few."""
    few = files.select("file_path").distinct().limit(NAMED_FILES + 1).collect()
    if len(few) <= NAMED_FILES:
        rows = rows.where(F.col("file_path").isin([r["file_path"] for r in few]))
    return marked(rows, files, FILE)


def question(wanted: DataFrame) -> str:
    """One digest for all that jobs ask for, whatever the order of ``wanted(job_id, solution, assembly_lc)``."""
    told = F.md5(F.concat_ws("\0", "job_id", "solution", "assembly_lc"))
    row = wanted.distinct().select(*digest_parts(told)).agg(*digest_sums()).select(digest_text().alias("d")).first()
    return row["d"] or ""


class ChangeStore:
    """Usages below ``root``, for one set of jobs; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, part: str, only: list[str] | None = None) -> DataFrame:
        found = generations(self.spark, self.root, "commits") if only is None else only
        schema = _SCHEMAS[part] + ", generation string"
        paths = [f"{self.root}/{part}/generation={g}" for g in found if complete(self.spark, f"{self.root}/{part}/generation={g}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{part}").parquet(*paths)

    def state(self) -> Snapshot:
        """The files as of the last update; none before the first."""
        last = generations(self.spark, self.root, "commits")[-1:]
        return Snapshot(self._read("files", last).drop("generation"), self._read("folders", last).drop("generation"))

    def committed(self, batch: str) -> bool:
        return not self._read("commits").where(F.col("batch") == batch).isEmpty()

    def asked(self) -> str | None:
        """What the stored usages answer; null before the first update."""
        first = self._read("commits").orderBy("generation").first()
        return first["question"] if first else None

    def usages(self, files: DataFrame | None = None) -> DataFrame:
        """Merged on read: rows of a file count if no later generation gave it a tombstone; of ``files`` only, if given."""
        rows, dead = self._read("usages"), self._read("tombstones")
        if files is not None:
            rows, dead = of_files(rows, files), of_files(dead, files)
        dead = cut(dead.groupBy(*FILE).agg(F.max("generation").alias("since")), "side")
        merged = marked(rows, dead, FILE, "left")
        return merged.where("since IS NULL OR generation >= since").select(*USAGE_COLUMNS)

    def counts(self) -> DataFrame:
        """``(job_id, solution, project_name, usage_type, n)``: the sum of all signed counts."""
        summed = self._read("counts").groupBy(*COUNTED).agg(F.sum("n").alias("n"))
        return summed.where("n <> 0")

    def by_project(self) -> DataFrame:
        return self.counts().groupBy("job_id", "project_name").agg(F.sum("n").alias("usages"))

    def rollup(self) -> DataFrame:
        """Counts by job, project and type with subtotals; null stands for all."""
        return self.counts().rollup("job_id", "project_name", "usage_type").agg(F.sum("n").alias("usages"))

    def next_generation(self) -> str:
        """A name that sorts after all committed ones; what is written under it counts once its commit is there."""
        before = generations(self.spark, self.root, "commits")
        number = int(before[-1].split("-")[0]) + 1 if before else 1
        return f"{number:012d}-{uuid.uuid4().hex}"

    def place(self, part: str, generation: str) -> str:
        return f"{self.root}/{part}/generation={generation}"

    def update(self, batch: str, asks: str, diff: DataFrame, state: Snapshot, usages: DataFrame, generation: str) -> None:
        """Replace what is stored of changed and removed files by ``usages`` of the changed and added ones.

        ``diff(solution, file_path, change)``; the files of ``state`` are at their ``place`` in
        ``generation`` already. A batch that is committed already does
        nothing; one that died half-way leaves no trace and is done anew.
        """
        if self.committed(batch):
            return

        def write(rows: DataFrame, part: str) -> DataFrame:
            path = self.place(part, generation)
            rows.write.parquet(path)
            return self.spark.read.schema(_SCHEMAS[part]).parquet(path)

        dead = write(diff.where("change <> 'added'").select(*FILE), "tombstones")
        old = self.usages(cut(dead, "dead-files")).groupBy(*COUNTED).agg((-F.count(F.lit(1))).alias("n"))
        # Written before it is laid out: dealing out by ranges samples its input first.
        fresh = cut(usages.select(*USAGE_COLUMNS), "fresh-usages")
        place = [*FILE, "start_line"]
        # Many usages were dealt out by file as they were matched: they stay there, in order within each task.
        laid_out = fresh.repartitionByRange(*place) if fits_broadcast(fresh) else fresh
        write(laid_out.sortWithinPartitions(*place), "usages")
        new = fresh.groupBy(*COUNTED).agg(F.count(F.lit(1)).alias("n"))
        write(old.unionByName(new).groupBy(*COUNTED).agg(F.sum("n").alias("n")).where("n <> 0"), "counts")
        write(state.folders, "folders")
        write(self.spark.createDataFrame([(batch, asks)], _SCHEMAS["commits"]).coalesce(1), "commits")
