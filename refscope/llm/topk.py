"""Exact top-k search by inner product: histograms of all scores locate each query's kth value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refscope.llm.common import written

#: Rows of one block of queries and of one block of candidates; a task scores one pair of blocks at a time.
QUERY_BLOCK = 2048
ROW_BLOCK = 4096
#: Bins of a histogram; a value is found after log(range) / log(bins) rounds.
BINS = 256
_TILE = 1024
#: Whole numbers up to here multiply and add exactly as doubles.
_EXACT = 2.0**53
#: Stands for "no score".
_NONE = -(2**63 - 1)


def whole_numbers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as long; null if the vector or any component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    count = max(1, -(-rows.count() // size))
    return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(count)).cast("int")), count


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors])


def _scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact as long as they fit into a long."""
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < _EXACT:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    if bound >= 2.0**63:
        raise OverflowError("an inner product may not fit into a long")
    return left @ right.T


def _tiles(queries: pd.DataFrame, rows: pd.DataFrame) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Scores tile by tile: (queries, places of the rows, scores); a row is not scored against itself."""
    ids, q = rows["row"].to_numpy(), _matrix(queries["v"])
    own = queries["row"].to_numpy()
    for at in range(0, len(rows), ROW_BLOCK):
        some = _matrix(rows["v"].iloc[at : at + ROW_BLOCK])
        these = slice(at, at + ROW_BLOCK)
        for start in range(0, len(queries), _TILE):
            part = slice(start, start + _TILE)
            yield part, these, np.where(own[part, None] == ids[None, these], _NONE, _scores(q[part], some))


def _histogram(k: int):
    """Per query a histogram of all scores of a block, from the top down to the bin that completes ``k``.

    The kth value of all rows lies no lower than the kth of one block, so deeper bins need not be summed.
    """

    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        n = len(queries)
        counts = np.zeros((n, BINS + 2), np.int64)
        if n and len(rows):
            low, width = queries["low"].to_numpy(), queries["width"].to_numpy()
            for part, _, score in _tiles(queries, rows):
                size = score.shape[0]
                # Bin 0 is below the range, the last one above it.
                bins = np.clip((score - low[part, None]) // width[part, None], -1, BINS) + 1
                flat = (np.arange(size)[:, None] * (BINS + 2) + bins)[score != _NONE]
                counts[part] += np.bincount(flat, minlength=size * (BINS + 2)).reshape(size, -1)
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        at, bins = np.nonzero((counts > 0) & (above < k))
        return pd.DataFrame({"query": queries["row"].to_numpy(np.int64)[at], "bin": bins - 1, "n": counts[at, bins]})

    return run


def _winners(k: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            ids, kth = queries["row"].to_numpy(), queries["kth"].to_numpy()
            names, others, vecs = queries["vec_id"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].to_numpy()
            for part, these, score in _tiles(queries, rows):
                at, col = np.nonzero((score >= kth[part, None]) & (score != _NONE))
                found = pd.DataFrame(
                    {
                        "query": ids[part][at],
                        "query_id": names[part][at],
                        "vec_id": vecs[these][col],
                        "row": others[these][col],
                        "score": score[at, col],
                    }
                )
                # Of equal scores no block has more than k winners, those of the smallest ids.
                found = found.sort_values(["query", "score", "vec_id", "row"], ascending=[True, False, True, True])
                out.append(found.groupby("query").head(k))
        if not out:
            return pd.DataFrame({c: np.empty(0, np.int64) for c in ("query", "query_id", "vec_id", "row", "score")})
        return pd.concat(out)

    return run


def top_k(
    vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` picks, its ``k`` best other rows.

    Scores are inner products of the vectors' ``scale``-fold whole numbers. Every
    query is scored against every row, in pairs of bounded blocks that a shuffle
    brings together. A round sums histograms of the scores over all blocks; the
    bin that holds a query's kth value is the range of its next round, until bins
    are one wide. Then rows at or above the kth value are taken, ties to the
    smaller id.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without id; only vectors of one dimension are compared. Rows of
    one id are rows of their own: each is a candidate for all others, and each
    that ``queries`` picks has its own ranks. A query with fewer than ``k`` partners gets
    all; an empty table gives none. Other columns are ignored. Scores beyond a long raise.
    """
    rows = vectors.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").cast("long").alias("vec_id"),
        whole_numbers(F.col(f"`{vector_column}`"), scale).alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    )
    rows = rows.where("v IS NOT NULL AND size(v) > 0").withColumn("dim", F.size("v"))
    # Ids may repeat; the numbers, written with the rows, tell these apart.
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where("asks").drop("asks")
    asked, query_blocks = _blocks(asked, QUERY_BLOCK, "qb")
    held, row_blocks = _blocks(rows.drop("asks"), ROW_BLOCK, "rb")
    left = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    right = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    pair = ["dim", "qb", "rb"]
    # New names of the same columns tell the two sides apart.
    held = held.withColumn("qb", left).select(*[F.col(c).alias(c) for c in ("row", "vec_id", "v", "dim", "rb", "qb")])

    def scored(state: DataFrame, run, schema: str) -> DataFrame:
        some = asked.join(state, "row").withColumn("rb", right)
        return some.groupBy(*pair).cogroup(held.groupBy(*pair)).applyInPandas(run, schema)

    # No score is larger than the square of the largest component times the dimension.
    largest = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    peak = rows.agg(F.max(largest * largest * F.col("dim"))).first()[0] or 0.0
    if peak >= 2.0**62:
        raise OverflowError("scores may not fit into a long")
    most = int(peak * (1 + 1e-9)) + 1
    width = max(1, -(-(2 * most + 1) // BINS))
    longs = lambda x: F.lit(x).cast("long")
    state = written(asked.select("row", longs(-most).alias("low"), longs(width).alias("width")), "ranges")
    while True:
        counted = scored(state, _histogram(k), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("query").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("upto", F.sum("n").over(above))
        # The first bin from the top that completes k; a query with fewer partners ends at its lowest bin.
        chosen = counted.groupBy("query").agg(
            F.max(F.when(F.col("upto") >= k, F.col("bin"))).alias("full"), F.min("bin").alias("least")
        )
        chosen = chosen.select(F.col("query").alias("row"), F.coalesce("full", "least").alias("bin"))
        state = state.join(chosen, "row").select("row", (F.col("low") + F.col("bin") * F.col("width")).alias("low"))
        if width == 1:
            break
        width = -(-width // BINS)
        state = written(state.withColumn("width", longs(width)), "ranges")
    state = written(state.select("row", F.col("low").alias("kth")), "kth")
    found = scored(state, _winners(k), "query long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id", "row")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
