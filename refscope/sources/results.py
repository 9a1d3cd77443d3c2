"""Stored results: usage rows by generation, and one header per stored result.

Saving only ever appends. A save writes the rows of all its jobs as one
generation, sketches of what they hold, and then the headers that point there, so a result becomes visible
whole or not at all. Generations are numbered: a later save, or a later
``invalidate``, replaces an earlier one whatever any machine's clock says.
``compact`` removes what is replaced or forgotten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.operators.reports import SPREAD, usage_sketches
from refscope.runtime import cut, fits_broadcast, is_written, join_bounded
from refscope.schemas import USAGE_SCHEMA

HEADER = "fingerprint string, job_id string, usage_count bigint, saved_at timestamp, generation string"
USAGES = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in USAGE_SCHEMA) + ", fingerprint string"
SKETCHES = "fingerprint string, usages bigint, " + ", ".join(f"{name} binary" for name in SPREAD)

# So many asked-for results are named in the scan itself, which then skips files and row groups.
NAMED_RESULTS = 1_000


def _files(spark: SparkSession, path: str):
    """(file system, path object) of a place in the store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def complete(spark: SparkSession, path: str) -> bool:
    files, mark = _files(spark, f"{path}/_SUCCESS")
    return files.exists(mark)


def generations(spark: SparkSession, root: str, part: str = "headers") -> list[str]:
    """Generations whose ``part``, the one written last, is all there, oldest first."""
    files, place = _files(spark, f"{root}/{part}")
    names = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    found = sorted(n.removeprefix("generation=") for n in names if n.startswith("generation="))
    return [g for g in found if complete(spark, f"{root}/{part}/generation={g}")]


def _next_generation(spark: SparkSession, root: str) -> str:
    """A name that sorts after all others; two savers at once differ by its end."""
    last = generations(spark, root)[-1:]
    number = int(last[0].split("-")[0]) + 1 if last else 1
    return f"{number:012d}-{uuid.uuid4().hex}"


def _headers(spark: SparkSession, root: str) -> DataFrame:
    paths = [f"{root}/headers/generation={g}" for g in generations(spark, root)]
    if not paths:
        return spark.createDataFrame([], HEADER)
    return spark.read.schema(HEADER).option("basePath", f"{root}/headers").parquet(*paths)


def _write_headers(headers: DataFrame, root: str, generation: str) -> None:
    headers.select("fingerprint", "job_id", "usage_count", F.current_timestamp().alias("saved_at")).write.parquet(
        f"{root}/headers/generation={generation}"
    )


def save_results(jobs: DataFrame, usages: DataFrame, root: str) -> None:
    """Store the results of ``jobs(job_id, fingerprint)``; an older result is superseded.

    Rows are laid out by fingerprint, then place: a reader of a few results
    touches few files, and a result of any size spreads over several.
    """
    spark = usages.sparkSession
    generation = _next_generation(spark, root)
    # Jobs that ask for the same thing have the same result; it is stored once.
    keyed = jobs.where(F.col("fingerprint").isNotNull()).groupBy("fingerprint").agg(F.min("job_id").alias("job_id"))
    keyed = cut(keyed, "stored-jobs")
    rows = join_bounded(usages, keyed, ["job_id"], written=True)
    # Dealing out by ranges samples its input first: written, so that nothing is matched twice. A written table that
    # few jobs are looked up for is read twice at less than the cost of a copy.
    if not (is_written(usages) and fits_broadcast(keyed)):
        rows = cut(rows, "generation")
    _write_generation(rows, keyed, root, generation)


def _write_generation(rows: DataFrame, keyed: DataFrame, root: str, generation: str) -> None:
    """Rows first, then their sketches, out of what was written, then the headers with their counts.

    A task that sketches written rows meets few results, so its partial sketches are few.
    """
    place = ["fingerprint", "project_name", "file_path", "start_line"]
    path = f"{root}/usages/generation={generation}"
    rows.repartitionByRange(*place).sortWithinPartitions(*place).write.parquet(path)
    sketches = f"{root}/sketches/generation={generation}"
    written = rows.sparkSession.read.schema(USAGES).parquet(path)
    usage_sketches(written, "fingerprint").write.parquet(sketches)
    counts = rows.sparkSession.read.schema(SKETCHES).parquet(sketches).select("fingerprint", F.col("usages").alias("usage_count"))
    header = keyed.join(counts, "fingerprint", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
    _write_headers(header, root, generation)


def _latest(spark: SparkSession, root: str) -> DataFrame:
    newest = F.max(F.struct("generation", "job_id", "usage_count", "saved_at")).alias("h")
    return (
        _headers(spark, root)
        .groupBy("fingerprint")
        .agg(newest)
        .select("fingerprint", "h.generation", "h.job_id", "h.usage_count", "h.saved_at")
        .where(F.col("usage_count") >= 0)
    )


def stored_headers(spark: SparkSession, root: str) -> DataFrame:
    """Newest headers whose generation is there; a damaged, missing or forgotten result is a miss.

    Headers are written last and are trusted: no usage row is read. Of the
    generations (few, after ``compact``) only the writer's mark is looked for.
    """
    there = [g for g in generations(spark, root) if complete(spark, f"{root}/usages/generation={g}")]
    return _latest(spark, root).where(F.col("generation").isin(there) | (F.col("usage_count") == 0))


def load_results(spark: SparkSession, root: str, jobs: DataFrame) -> DataFrame:
    """Stored usage rows for ``jobs(job_id, fingerprint)``, from the newest generation.

    Only the generations that hold an asked-for result are read, by their own
    paths. Rows carry the asking job's id, whatever the job was called when it was stored.
    """
    asked = jobs.select("fingerprint", "job_id")
    wanted = cut(stored_headers(spark, root).select("generation", "fingerprint").join(asked, "fingerprint"), "wanted")
    # One value a save, not one a result.
    generations = sorted(r["generation"] for r in wanted.select("generation").distinct().collect())
    paths = [f"{root}/usages/generation={g}" for g in generations if complete(spark, f"{root}/usages/generation={g}")]
    if not paths:
        return spark.createDataFrame([], USAGES)
    rows = spark.read.schema(f"{USAGES}, generation string").option("basePath", f"{root}/usages").parquet(*paths)
    few = [r["fingerprint"] for r in wanted.select("fingerprint").distinct().limit(NAMED_RESULTS + 1).collect()]
    if len(few) <= NAMED_RESULTS:
        rows = rows.where(F.col("fingerprint").isin(few))
    return join_bounded(rows.drop("job_id"), wanted, ["generation", "fingerprint"], written=True).drop("generation")


def load_sketches(spark: SparkSession, root: str, jobs: DataFrame) -> DataFrame:
    """``(job_id, usages, files, projects, symbols)``: stored sketches for ``jobs(job_id, fingerprint)``.

    No usage is read. A stored result without usages has a count of 0 and null sketches; one that is not stored
    has no row. Results stored before there were sketches raise an error: ``compact`` makes theirs.
    """
    headers = stored_headers(spark, root).select("generation", "fingerprint", "usage_count")
    wanted = cut(headers.join(jobs.select("fingerprint", "job_id"), "fingerprint"), "wanted")
    needed = sorted(r["generation"] for r in wanted.where("usage_count > 0").select("generation").distinct().collect())
    paths = [f"{root}/sketches/generation={g}" for g in needed]
    if missing := [p for p in paths if not complete(spark, p)]:
        raise ValueError(f"no sketches at {missing[0]}; compact the store")
    stored = spark.createDataFrame([], f"{SKETCHES}, generation string")
    if paths:
        stored = spark.read.schema(f"{SKETCHES}, generation string").option("basePath", f"{root}/sketches").parquet(*paths)
    found = wanted.join(stored, ["generation", "fingerprint"], "left")
    return found.select("job_id", F.col("usage_count").alias("usages"), *SPREAD)


def invalidate(spark: SparkSession, root: str, keys: DataFrame) -> None:
    """Forget the results of ``keys`` by a newer header without rows. Harmless if not stored."""
    gone = _latest(spark, root).join(keys.select("fingerprint").distinct(), "fingerprint", "left_semi")
    forgotten = gone.withColumn("usage_count", F.lit(-1).cast("bigint"))
    _write_headers(forgotten, root, _next_generation(spark, root))


def compact(spark: SparkSession, root: str) -> None:
    """Write all live results as one new generation and remove every older one.

    Superseded and forgotten rows are gone afterwards. Older generations go
    oldest first, headers before rows, so that a run that dies half-way leaves
    no forgotten result without the header that hides it. Run it alone.
    """
    old = generations(spark, root)
    if not old:
        return
    live = cut(stored_headers(spark, root).select("fingerprint", "job_id"), "live")
    _write_generation(cut(load_results(spark, root, live), "generation"), live, root, _next_generation(spark, root))
    for generation in old:
        for part in ("headers", "sketches", "usages"):
            files, place = _files(spark, f"{root}/{part}/generation={generation}")
            files.delete(place, True)
