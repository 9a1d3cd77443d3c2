"""Token totals kept up to date by signed deltas, one committed batch at a time."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.llm.common import bounded_batches, written

KEYS = ("source", "lang", "tokenizer")
_MOST_RANKS = 1_000_000
#: Fixed value: the pattern that cuts texts before byte pairs are merged, as published with these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, tiktoken.Encoding] = {}


def token_count(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """Tokens of whole texts in a vocabulary file of ranks; null for null.

    The driver reads the file, whose size is bounded, and sends it to the tasks.
    """
    bounded_batches(spark)
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > _MOST_RANKS:
        raise ValueError(f"{len(ranks)} ranks are too many to send to every task")
    sent, number = spark.sparkContext.broadcast(ranks), hash(frozenset(ranks.items()))

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if number not in _encoders:
            _encoders[number] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
        encode = _encoders[number].encode_ordinary
        for some in texts:
            yield pd.Series([None if t is None else len(encode(t)) for t in some], dtype="Int64")

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long").asNondeterministic()(text)


def signed(events: DataFrame) -> DataFrame:
    """Totals that ``events`` add: ``(source, lang, tokenizer, docs, tokens)``, signed.

    Events have the columns ``op, source, lang, tokenizer, tokens`` and, for what
    was counted before, ``old_source, old_lang, old_tokenizer, old_tokens``. An
    ``insert`` adds the new values, a ``delete`` takes the old ones away, a
    ``revise`` does both; another ``op`` raises. Null keys are groups of their own, null counts
    are zero. Each event is one row and counts as often as it occurs.
    """
    known = F.col("op").isin("insert", "delete", "revise")
    op = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))))
    adds = F.struct(*[F.col(c).alias(c) for c in KEYS], F.lit(1).alias("sign"), F.col("tokens").alias("tokens"))
    takes = F.struct(*[F.col(f"old_{c}").alias(c) for c in KEYS], F.lit(-1).alias("sign"), F.col("old_tokens").alias("tokens"))
    parts = F.when(op == "insert", F.array(adds)).when(op == "delete", F.array(takes)).otherwise(F.array(takes, adds))
    rows = events.select(F.explode(parts).alias("x")).select("x.*")
    return rows.groupBy(*KEYS).agg(
        F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens")
    )


class Rollup:
    """Additive totals in a folder all executors share: one small table of deltas for each batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError(f"a batch is named by letters, digits and ._-, not {batch!r}")
        return f"{self.root}/batch={batch}"

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        return jvm.org.apache.hadoop.fs.Path(path)

    def committed(self, batch: str) -> bool:
        """Whether the batch is whole: the writer's mark is set after all its files."""
        mark = self._file(f"{self._path(batch)}/_SUCCESS")
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Add the events of ``batch`` once; a batch committed before changes nothing (false).

        A batch that died half-way has no mark; it is written anew by its retry.
        """
        if self.committed(batch):
            return False
        signed(events).coalesce(1).write.mode("overwrite").parquet(self._path(batch))
        return True

    def batches(self) -> list[str]:
        root = self._file(self.root)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and self.committed(n.removeprefix("batch=")))

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, docs, tokens)`` over all committed batches; groups that have come to nothing go."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        found = [self._path(b) for b in self.batches()]
        rows = self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 OR tokens <> 0")


def counted(docs: DataFrame, vocabularies: dict[str, str], tokenizer: Column) -> DataFrame:
    """``(doc_id, source, lang, copy, <name>...)``: token counts of every row, written once.

    ``vocabularies`` maps a tokenizer's name to its file; ``tokenizer`` lists the
    names to count a row with. ``copy`` is a digest of the text.
    """
    spark = docs.sparkSession
    counts = [
        token_count(spark, F.when(F.array_contains(tokenizer, name), F.col("text")), path).alias(name) for name, path in vocabularies.items()
    ]
    copy = F.struct(F.xxhash64("text").alias("a"), F.xxhash64("text", F.lit(1)).alias("b")).alias("copy")
    return written(docs.select("doc_id", "source", "lang", copy, *counts), "token-counts")


def event(op: str, rows: DataFrame, new: tuple[Column, Column] | None, old: tuple[Column, Column] | None) -> DataFrame:
    """Rows of a counted table as events; ``new`` and ``old`` are (tokenizer, tokens)."""
    none = (F.lit(None).cast("string"), F.lit(None).cast("long"))
    tokenizer, tokens = new or none
    before, count = old or none
    keep = lambda side, c: F.col(c) if side else F.lit(None).cast("string")
    return rows.select(
        F.lit(op).alias("op"), keep(new, "source").alias("source"), keep(new, "lang").alias("lang"), tokenizer.alias("tokenizer"),
        tokens.cast("long").alias("tokens"), keep(old, "source").alias("old_source"), keep(old, "lang").alias("old_lang"),
        before.alias("old_tokenizer"), count.cast("long").alias("old_tokens"),
    )

