"""Helpers every operator shares: written cuts of known size, bounded broadcasts, their removal."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
# Keys of a side too large to broadcast, but of at most ``MARKED_ROWS``, are marked in ``MARK_PAGES`` bitmaps of 4 KB each.
MARKED_ROWS = 8_000_000
MARK_PAGES = 2_048
PAGE_BITS = 32_768


@dataclass(frozen=True)
class Size:
    """Rows of a written table and their bytes, unpacked."""

    rows: int
    bytes: int


# What ``cut`` wrote: by table, and by application in the order of writing.
_sizes: WeakKeyDictionary[DataFrame, Size] = WeakKeyDictionary()
_paths: dict[str, list[str]] = {}
_own_roots: dict[str, str] = {}
# Called with each table about to be cut; tests look at the plans behind cuts here.
watchers: list[Callable[[DataFrame, str], None]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, named by ``spark.checkpoint.dir``.

    A cluster must name it: a folder on one machine is lost with that machine.
    Only where it is unset and the session is local, as in tests, a folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="refscope-")
        atexit.register(shutil.rmtree, _own_roots[app], ignore_errors=True)
    return _own_roots[app]


def _row_bytes(df: DataFrame) -> Column:
    """Estimate of a row in memory: 16 bytes a column and what strings and nested values hold."""

    def held(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0)) + F.lit(16)
        if isinstance(kind, T.StructType):
            return reduce(lambda x, y: x + y, [held(column.getField(f.name), f.dataType) for f in kind.fields], F.lit(16))
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + F.lit(16)
        return F.lit(16)

    return reduce(lambda x, y: x + y, [held(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields], F.lit(0)).cast("bigint")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives lost executors, has a short lineage, is columnar
    (a later step reads only its columns) and has a known size: rows and bytes are
    observed while they are written, at no further pass or exchange. ``released``
    removes the tables again.
    """
    spark = df.sparkSession
    path = own_folder(spark, label)
    for watch in watchers:
        watch(df, label)
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_row_bytes(df)).alias("bytes"))
    watched.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    found = seen.get
    _sizes[table] = Size(found.get("rows") or 0, found.get("bytes") or 0)
    return table


def own_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared place, removed with the tables that ``cut`` wrote."""
    path = f"{scratch_root(spark)}/refscope/{label}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession, keep: int = 0) -> int:
    """Remove all tables this application has cut but the first ``keep``; returns how many went."""
    paths = _paths.get(spark.sparkContext.applicationId, [])
    gone = paths[keep:]
    del paths[keep:]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in gone:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Own all tables cut inside the block and remove them at its end.

    What the block computed must be stored or collected by then: a DataFrame
    that reads a removed table fails.
    """
    before = len(_paths.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        release(spark, before)


def spread(table: DataFrame) -> DataFrame:
    """Deal out a stored table that would be read by far fewer tasks than there are cores.

    For steps that compute much per row. Tables of many files are left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() * 2 > cores:
        return table
    return table.repartition(cores)


def is_written(table: DataFrame) -> bool:
    """Whether a table was made by ``cut``: reading it again computes nothing again."""
    return table in _sizes


def written_rows(table: DataFrame) -> int:
    """Rows of a table made by ``cut``, as they were counted at its writing."""
    return _sizes[table].rows


def fits_broadcast(table: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether a table made by ``cut`` is small. Nothing is run: its size is known from its writing."""
    known = _sizes.get(table)
    if known is None:
        raise ValueError("only a written table has a known size")
    most_rows, most_bytes = rows or BROADCAST_ROWS, size or BROADCAST_BYTES
    return known.rows <= most_rows and known.bytes <= most_bytes


def join_bounded(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", written: bool = False
) -> DataFrame:
    """Join a large side with one that is usually small.

    The small side is written first (unless it already is a table made by ``cut``).
    Known to be small: broadcast, the large side does not move. Otherwise a
    shuffle join; adaptive execution splits the partitions of hot keys among
    tasks and hands the other side's rows of those keys, and no others, to each.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how} does not keep the large side whole")
    side = small if written else cut(small, "side")
    return big.join(F.broadcast(side) if fits_broadcast(side) else side.hint("merge"), on, how)


def marked(big: DataFrame, side: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """``join_bounded`` with a written ``side`` that few of the large rows meet.

    Beyond the broadcast bounds the keys of ``side`` are marked by hash in bitmaps of 8 MB in all, which are
    broadcast: rows without a mark meet nothing and stay where they are, the others are joined. A left join
    reads the large side twice, so that should be stored.
    """
    if how not in ("left_semi", "left"):
        raise ValueError(f"join type {how} is not looked up by marks")
    if fits_broadcast(side) or _sizes[side].rows > MARKED_ROWS:
        return join_bounded(big, side, on, how, written=True)
    place = F.pmod(F.xxhash64(*on), F.lit(MARK_PAGES * PAGE_BITS))
    page, bit = F.floor(place / PAGE_BITS).cast("int"), place % PAGE_BITS
    marks = side.select(page.alias("_page"), bit.alias("_at")).groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_marks"))
    marks = cut(marks, "marks")
    met = big.withColumns({"_page": page, "_at": bit}).join(F.broadcast(marks), "_page", "left")
    byte = F.conv(F.hex(F.substr("_marks", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    joined = join_bounded(met.where(hit).select(*big.columns), side, on, how, written=True)
    if how == "left_semi":
        return joined
    return joined.unionByName(met.where(~hit).select(*big.columns), allowMissingColumns=True)


def local_session(cores: str = "8", app: str = "refscope") -> SparkSession:
    """A session for tests and the benchmark on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores) if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )
