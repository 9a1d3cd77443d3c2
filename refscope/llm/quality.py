"""Document quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refscope.llm.common import bounded_batches

#: Bounds of the training sample: documents of either label, and lines of all of these together.
TRAIN_DOCS = 3000
TRAIN_LINES = 100_000
#: A document is predicted good from this score on.
GOOD = 0.7
_STEPS, _RATE, _DECAY = 120, 0.15, 1e-2
_LINES_AT_ONCE = 20_000

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:'\"?()-"
_SPACE = b" \t\r\x0b\x0c"
FEATURES = 13


def line_features(line: bytes, before: bytes | None) -> tuple:
    """What one line looks like; shares of its bytes or words."""
    n = max(len(line), 1)
    words = line.split()
    count = max(len(words), 1)

    def share(kind: bytes) -> float:
        return (len(line) - len(line.translate(None, kind))) / n

    letters = share(_LETTERS)
    upper, digits, stops = share(_UPPER), share(_DIGITS), share(_STOPS)
    return (
        1.0,
        np.log1p(len(line)),
        np.log1p(len(words)),
        upper / letters if letters else 0.0,
        digits,
        stops,
        max(0.0, 1 - letters - digits - stops - share(_SPACE)),
        line.count(b"!") / count,
        line.count(b"|") / count,
        min(len(line) / count, 40.0),
        sum(map(eq, words, words[1:])) / count,
        len(set(words)) / count if words else 1.0,
        float(line == before),
    )


def text_lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of the lines of a text that are not blank."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    found = [line_features(x, y) for x, y in zip(lines, [None, *lines], strict=False)]
    return np.array(found, dtype=np.float64).reshape(-1, FEATURES), np.array([len(x) for x in lines], dtype=np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines before and after it; zeros at the ends."""
    none = np.zeros((min(1, len(x)), FEATURES))
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none])])


@dataclass(frozen=True)
class Model:
    """Weights of a two-state chain: state 1 is a good line."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    @property
    def fitted(self) -> bool:
        """Whether the sample held both labels; without them all weights are zero."""
        return bool(self.weights.any() or self.moves.any() or self.first.any())

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def forward_backward(unary: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray):
    """Marginals of padded chains: P(good) per line, expected moves, and the log of the normaliser.

    ``unary`` is documents x lines, the score of "good" (that of "bad" is zero).
    """
    docs, most = unary.shape
    u = np.stack([np.zeros_like(unary), unary], axis=2)
    ahead = np.empty((docs, most, 2))
    behind = np.zeros((docs, most, 2))
    ahead[:, 0] = first + u[:, 0]
    for t in range(1, most):
        step = ahead[:, t - 1, :, None] + moves
        ahead[:, t] = np.logaddexp(step[:, 0], step[:, 1]) + u[:, t]
    for t in range(most - 2, -1, -1):
        step = moves + (u[:, t + 1] + behind[:, t + 1])[:, None, :]
        inside = (t + 1 < lengths)[:, None]
        behind[:, t] = np.where(inside, np.logaddexp(step[:, :, 0], step[:, :, 1]), 0.0)
    end = ahead[np.arange(docs), lengths - 1]
    total = np.logaddexp(end[:, 0], end[:, 1])
    good = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None])
    pair = ahead[:, :-1, :, None] + moves + (u[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    live = (np.arange(1, most) < lengths[:, None])[:, :, None, None]
    return good, np.where(live, np.exp(np.minimum(pair, 0.0)), 0.0), total


def _lots(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Documents in lots of like length, so that padding is small and memory bounded."""
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and counts[order[stop]] * (stop + 1 - at) <= _LINES_AT_ONCE and (
            counts[order[stop]] <= 2 * counts[order[at]] + 4
        ):
            stop += 1
        yield order[at:stop]
        at = stop


def _padded(parts: list[np.ndarray], lot: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lot), len(parts[lot[-1]]), *parts[lot[-1]].shape[1:]))
    for row, i in enumerate(lot):
        out[row, : len(parts[i])] = parts[i]
    return out


def train(documents: list[tuple[np.ndarray, int]]) -> Model:
    """Weights from (features of the lines, label) pairs; every line has its document's label.

    Gradient ascent (Adam) on the conditional likelihood. Without documents of
    both labels all weights are zero.
    """
    width = 3 * FEATURES
    xs = [with_neighbours(x) for x, _ in documents if len(x)]
    labels = np.array([y for x, y in documents if len(x)], dtype=int)
    zero = Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), np.zeros(2))
    if len(set(labels.tolist())) < 2:
        return zero
    rows = np.vstack(xs)
    mean, scale = rows.mean(0), rows.std(0)
    mean[0] = 0.0
    scale[scale < 1e-9] = 1.0
    counts = np.array([len(x) for x in xs])
    xs = [(x - mean) / scale for x in xs]
    lots = [(lot, _padded(xs, lot), counts[lot], labels[lot]) for lot in _lots(counts)]
    theta = np.zeros(width + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, _STEPS + 1):
        slope = -_DECAY * theta * len(xs)
        for _, x, n, y in lots:
            moves, first = theta[width : width + 4].reshape(2, 2), theta[width + 4 :]
            good, pairs, _ = forward_backward(x @ theta[:width], n, moves, first)
            live = np.arange(x.shape[1]) < n[:, None]
            slope[:width] += np.einsum("dt,dtf->f", np.where(live, y[:, None] - good, 0.0), x)
            seen = np.zeros((2, 2))
            np.add.at(seen, (y, y), n - 1.0)
            slope[width : width + 4] += (seen - pairs.sum((0, 1))).ravel()
            slope[width + 4 :] += np.bincount(y, minlength=2) - np.array([(1 - good[:, 0]).sum(), good[:, 0].sum()])
        slope /= len(xs)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + _RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, theta[:width], theta[width : width + 4].reshape(2, 2), theta[width + 4 :])


def score_texts(texts: list[bytes | None], model: Model) -> np.ndarray:
    """Length-weighted mean of the lines' P(good); zero for texts without words."""
    out = np.zeros(len(texts))
    held, held_lines = [], 0

    def settle():
        unary = [model.unary(with_neighbours(x)) for _, x, _ in held]
        for lot in _lots(np.array([len(u) for u in unary])):
            n = np.array([len(unary[i]) for i in lot])
            good, _, _ = forward_backward(_padded(unary, lot), n, model.moves, model.first)
            for row, i in enumerate(lot):
                at, _, size = held[i]
                out[at] = min(1.0, float(good[row, : n[row]] @ size / size.sum()))
        held.clear()

    for at, text in enumerate(texts):
        x, size = text_lines(text or b"")
        if len(x):
            held.append((at, x, size))
            held_lines += len(x)
        if held_lines >= _LINES_AT_ONCE:
            settle()
            held_lines = 0
    settle()
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that are never trained on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    docs_per_label: int = TRAIN_DOCS,
    lines_per_label: int = TRAIN_LINES,
) -> Model:
    """A model from a bounded sample of labelled documents.

    At most ``docs_per_label`` documents of either label, those of the smallest id
    hashes, without held-out ones; of these as many, in that order, as have
    ``lines_per_label`` lines together. A document is taken with all its lines or
    not at all; one that alone has more lines than that is not taken. Ids with
    contradicting labels, null labels or null ids are left out.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
        .where("y = z")
    )
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(order, "doc_id").limit(docs_per_label).select(F.col("doc_id").alias("id"), "y")
        chosen = some if chosen is None else chosen.unionByName(some)

    def figures(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([text_lines(t)[0].astype("<f4").tobytes() for t in some])

    figures.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    text = F.col(f"`{text_column}`")
    found = docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text")).where("text IS NOT NULL")
    # The sample has a fixed bound, whatever the input.
    found = found.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    found = found.select("id", "y", F.pandas_udf(figures, "binary")(F.encode("text", "UTF-8")).alias("x"))
    found = found.withColumn("n", F.octet_length("x") / (4 * FEATURES)).where(F.col("n") <= lines_per_label)
    # Over the sample alone: at most docs_per_label rows of a label.
    first = Window.partitionBy("y").orderBy(F.xxhash64(F.col("id").cast("string")), "id").rowsBetween(Window.unboundedPreceding, 0)
    lines = found.withColumn("upto", F.sum("n").over(first)).where(F.col("upto") <= lines_per_label).select("id", "y", "x").collect()
    lines.sort(key=lambda r: str(r["id"]))
    return train([(np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float), int(r["y"])) for r in lines])


def score(text: Column, model: Model) -> Column:
    """Quality of whole texts between 0 and 1; null, empty and blank texts have 0."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series(score_texts(list(some), model))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(F.encode(text, "UTF-8"))


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``(row, doc_id, held_out, score, predicted)``.

    ``row`` holds the columns of ``docs`` whatever their names. Only the text
    makes the score. Repeated rows have the same score; a null id is not held out;
    an empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_column}`").alias("doc_id"),
        held_out(F.col(f"`{id_column}`")).alias("held_out"),
        score(F.col(f"`{text_column}`"), model).alias("score"),
    ).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
