"""Batch job lists: one JSON document holds ``{"jobs": [{...}, ...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_jobs(documents: DataFrame, column: str = "value") -> DataFrame:
    """``jobs(solution, package, version, force_refresh)`` from JSON documents.

    Keys are accepted in any casing. A document that is null, no JSON object,
    whose list is no array of objects, or that lacks a required key fails the
    run: an unread list must not look like an empty one. A null or absent list is empty.
    """
    doc = F.trim(F.col(column))
    bad = F.raise_error(F.lit("Failed to deserialize batch configuration")).cast("string")
    readable = doc.startswith("{") & F.get_json_object(doc, "$").isNotNull()
    keys = F.from_json(F.when(readable, doc).otherwise(bad), "map<string,string>")
    lists = F.map_filter(F.transform_keys(keys, lambda k, _: F.lower(k)), lambda k, v: (k == "jobs") & v.isNotNull())
    listed = F.try_element_at(lists, F.lit("jobs"))
    parts = F.from_json(listed, "array<string>")
    objects = listed.startswith("[") & parts.isNotNull() & F.forall(parts, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    checked = F.when(listed.isNull(), F.lit("[]")).when(objects, listed).otherwise(bad)
    items = F.from_json(checked, "array<map<string,string>>")
    job = F.transform_keys("item", lambda k, _: F.lower(k))
    parsed = documents.select(F.explode(items).alias("item")).select(job.alias("job"))

    def required(name: str) -> Column:
        missing = F.raise_error(F.lit(f"job without {name}")).cast("string")
        return F.coalesce(F.col("job")[F.lit(name)], missing)

    return parsed.select(
        required("solutionpath").alias("solution"),
        required("packagename").alias("package"),
        required("packageversion").alias("version"),
        F.coalesce(F.lower(F.col("job")[F.lit("forcerefresh")]) == "true", F.lit(False)).alias("force_refresh"),
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return parse_jobs(spark.read.text(path, wholetext=True))


def with_job_ids(jobs: DataFrame) -> DataFrame:
    """Name each job by what it asks for."""
    return jobs.withColumn("job_id", F.concat_ws("|", "solution", "package", "version"))
