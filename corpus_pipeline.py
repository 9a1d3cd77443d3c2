"""From raw documents to token ids: five stages, each written before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refscope.llm import decontam, linededup, pieces, quality, simhash
from refscope.llm.common import written
from refscope.llm.queries import LINE_WORDS, PIECE_MODEL, SIMHASH_DISTANCE, SIMHASH_SHINGLE, WINDOW_WORDS, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, predicts good.

    All documents, if the sample does not hold both labels, so that nothing could be fitted.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.fitted:
        return docs
    return quality.scored(docs, model).where("predicted = 1").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of later repeated runs; one of which nothing is left goes.

    ``n_chars`` follows the text. A document that was blank before stays.
    """
    found = linededup.without_repeats(docs, LINE_WORDS)
    found = found.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"\S"))
    changed = F.col("n_removed") > 0
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    columns = []
    for name, kind in docs.dtypes:
        old = F.col("row").getField(name)
        columns.append(F.when(changed, new[name].cast(kind)).otherwise(old).alias(name) if name in new else old.alias(name))
    return found.select(*columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, that of the smallest id."""
    return simhash.keep_one(docs, SIMHASH_SHINGLE, SIMHASH_DISTANCE)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), WINDOW_WORDS)
    return found.where("n_hit = 0").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    tokenizer = pieces.Tokenizer(spark, pieces.load(PIECE_MODEL))
    coded = docs.select("doc_id", "lang", "source", "text", tokenizer.coded(F.col("text")).alias("coded"))
    same = F.col("text").eqNullSafe(F.col("coded.decoded")).alias("round_trip")
    return coded.select("doc_id", "lang", "source", "coded.ids", F.size("coded.ids").cast("long").alias("n_pieces"), same)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmarks),
    ("sentencepiece", encoded),
]

#: SQL can neither fit the classifier nor run Viterbi; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = written(docs, name)
    return docs
