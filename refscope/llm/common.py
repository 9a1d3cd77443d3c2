"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.runtime import cut, fits_broadcast

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A written table is broadcast only if it has at most so many rows and bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Rows of whole texts in one batch for Python.
BATCH_ROWS = 256


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row, wherever ``body`` uses it.

    The optimizer may move a column's expression to the place where it is used,
    and so into a lambda that runs for every element; it leaves an array's elements alone.
    """
    return F.get(F.transform(F.array(value), body), 0)


def document_key(doc_id: Column, text: Column) -> Column:
    """What tells documents apart: the id and two hashes of the text.

    Rows that agree in id and text are one document and are treated alike; a
    null id or a repeated id is no obstacle.
    """
    return F.struct(doc_id.alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"))


def bounded_batches(spark: SparkSession) -> None:
    """Send at most ``BATCH_ROWS`` rows at a time to Python from now on.

    The rows hold whole texts: the usual 10,000 of them may be gigabytes.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def beside(written: DataFrame) -> DataFrame:
    """A written table as a join's side: broadcast if proven small, else shuffled (adaptive execution splits skew)."""
    return F.broadcast(written) if fits_broadcast(written, BROADCAST_ROWS, BROADCAST_BYTES) else written.hint("merge")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and not again when an executor is lost."""
    return cut(df, f"llm-{label}")
