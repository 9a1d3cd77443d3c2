"""Source files as a table: whole text, numbered lines, project inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.functions.paths import extension

# Extensions of files that are not read as text.
BINARY_EXTENSIONS = [
    ".dll", ".exe", ".pdb", ".lib", ".obj", ".bin", ".dat",
    ".zip", ".rar", ".7z", ".tar", ".gz",
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".ico",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
]

LINE_BREAK = r"\r\n|\r|\n"


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def drop_binary_files(files: DataFrame) -> DataFrame:
    return files.where(~is_binary(F.col("file_path")))


def split_lines(text: Column) -> Column:
    """All lines; a trailing line break gives a final empty line.

    Every ``LINE_BREAK`` becomes a line feed first: a text is split at one fixed character without a pattern.
    """
    fed = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(fed, "\n")


def read_source_files(spark: SparkSession, root: str, solution: str, pattern: str = "*") -> DataFrame:
    """``source_files(solution, project_name, file_path, mtime, text)`` below ``root``.

    The project is the first folder below ``root``. Binary files are left out at
    listing time, before any content is read. Bytes that are no UTF-8 give a null
    text, which ``unreadable_files`` reports; a file that cannot be fetched
    fails the run, so that a passing fault of the storage never looks like a
    smaller solution. Files of zero bytes have an empty text.
    """
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .where(~is_binary(F.col("path")))
    )
    path = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    inside = F.substring_index(path, root.rstrip("/") + "/", -1)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select(
        F.lit(solution).alias("solution"),
        F.when(inside.contains("/"), F.substring_index(inside, "/", 1)).otherwise(F.lit("")).alias("project_name"),
        inside.alias("file_path"),
        F.col("modificationTime").alias("mtime"),
        F.regexp_replace(text, "^\ufeff", "").alias("text"),
    )


def unreadable_files(files: DataFrame) -> DataFrame:
    """``project_errors(solution, project_name, error)``: one row for each file without a text."""
    return files.where(F.col("text").isNull()).select(
        "solution", "project_name", F.concat(F.lit("Cannot read file: "), F.col("file_path")).alias("error")
    )


def explode_lines(files: DataFrame) -> DataFrame:
    """``source_lines(solution, project_name, file_path, line_no, line)``, 1-based."""
    keys = ["solution", "project_name", "file_path"]
    return files.select(*keys, F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).cast("int").alias("line_no"), "line"
    )


def project_inventory(files: DataFrame) -> DataFrame:
    """Documents per project. Distinct paths first, so a hot project is counted in parts."""
    return (
        files.select("solution", "project_name", "file_path")
        .distinct()
        .groupBy("solution", "project_name")
        .agg(F.count("*").alias("documents"))
    )
