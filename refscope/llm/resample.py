"""Importance resampling: draw documents whose words look like those of a target collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refscope.llm.common import ascii_lower, beside, document_key, let, written

#: A line with more than this share of all lines is frequent; there are fewer than 1 / FREQUENT of them.
FREQUENT = 0.001
#: What stands between words: ASCII other than digits and small letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LINE = ("h1", "h2")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), _BETWEEN), "")


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")


def _starts(words: Column, n: int) -> Column:
    """1-based places where ``n`` words in a row begin."""
    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(none)


def _runs(words: Column, starts: Column, n: int, buckets: int) -> Column:
    return F.transform(starts, lambda i: _bucket(F.concat_ws(" ", F.slice(words, i, n)), buckets))


def _crossing(line: Column, starts: Column, n: int) -> Column:
    """Those of ``starts`` whose last word is in another line than the first."""
    return F.filter(starts, lambda i: F.get(line, i - 1) != F.get(line, i + (n - 2)))


def _within(words: Column, most: int, buckets: int) -> Column:
    """Buckets of all runs of 1 to ``most`` words of one line."""

    def of(w: Column) -> Column:
        longer = [_runs(w, _starts(w, n), n, buckets) for n in range(2, most + 1)]
        return F.concat(F.transform(w, lambda x: _bucket(x, buckets)), *longer)

    return let(words, of)


def _across(text: Column, most: int, buckets: int) -> Column:
    """Buckets of all runs of 2 to ``most`` words of a text that lie in more than one line."""

    def of(lines: Column) -> Column:
        words = F.flatten(lines)
        line = F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i, F.size(w))))
        return let(F.struct(words.alias("words"), line.alias("line")), runs)

    def runs(pair: Column) -> Column:
        w, line = pair["words"], pair["line"]
        return F.concat(*[_runs(w, _crossing(line, _starts(w, n), n), n, buckets) for n in range(2, most + 1)])

    return let(F.transform(F.split(text, "\n"), _words), of)


def _line_key(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def _segments(texts: DataFrame, most: int, buckets: int, label: str) -> DataFrame:
    """Distinct lines with their occurrences and the buckets of their features, each worked out once."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("line != ''")
    lines = lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    words = lines.select(*_line_key(F.col("line")), "times", _words(F.col("line")).alias("words")).where("size(words) > 0")
    found = words.select(*_LINE, "times", F.size("words").alias("n_words"), _within(F.col("words"), most, buckets).alias("buckets"))
    return written(found, label)


def _bucket_counts(segments: DataFrame, texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """Features per bucket: those of distinct lines times their occurrences, and those across lines."""
    found = segments.select("times", F.explode("buckets").alias("bucket"))
    if most > 1:
        found = found.unionByName(texts.select(F.lit(1).cast("long").alias("times"), F.explode(_across(F.col("text"), most, buckets)).alias("bucket")))
    return found.groupBy("bucket").agg(F.sum("times").alias("n"))


def _gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: how much more frequent it is in the target, in thousandths of a natural logarithm."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = both.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = written(both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    total = counts.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    more = F.col("t").cast("double") + 1, F.lit(float(total.s + buckets))
    less = F.col("s").cast("double") + 1, F.lit(float(total.t + buckets))
    gain = F.floor(F.lit(1000.0) * F.ln(more[0] * more[1] / (less[0] * less[1])))
    return written(counts.select("bucket", gain.alias("gain")), "gains")


def _numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows``, a written table, with ``place`` from 1 in a total order.

    Rows are dealt out by ranges of the order; each range is numbered by itself, from where the one before it ended.
    """
    ranges = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["part"], r["n"]) for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "part int, before long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranges.join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + inside).drop("part", "before")


def weighed(
    docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = 10_000, seed: str = "2024"
) -> DataFrame:
    """One row per document: ``key`` (its id and hashes of its text), ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score``.

    Features are the runs of 1 to ``most`` words, repeats counted; each falls into a
    bucket by CRC-32. A bucket's gain compares its smoothed shares in the texts of ``target``
    and in those of ``docs``; ``weight`` is the floored mean gain of a document's features. ``score`` adds
    Gumbel noise from a hash of ``seed`` and the id, so the highest scores are a draw
    without replacement by weight.

    Line feeds cut texts into lines. Features of distinct lines are worked out
    once, and counted times the line's occurrences; runs across lines are added document by
    document. For the weights each line's sum of gains is worked out once, too, and given back to
    the documents that hold the line: frequent lines by a broadcast of fewer than 1 / ``FREQUENT``
    rows, all others by a join.

    A null, empty or wordless text has no features and weight 0. Equal rows give as many equal
    rows; rows of one id with different texts are documents of their own. A row without id has
    a weight and no score. Only ``doc_id`` and ``text`` are read.
    """
    texts = docs.select("doc_id", "text")
    other = target.select("text")
    segments = _segments(texts, most, buckets, "segments")
    aims = _segments(other, most, buckets, "target-segments")
    gains = beside(_gains(_bucket_counts(segments, texts, most, buckets), _bucket_counts(aims, other, most, buckets), buckets))

    sums = segments.select(*_LINE, "times", "n_words", F.explode("buckets").alias("bucket")).join(gains, "bucket")
    sums = sums.groupBy(*_LINE).agg(
        F.first("times").alias("times"),
        F.first("n_words").cast("long").alias("w"),
        F.count(F.lit(1)).alias("n"),
        F.sum("gain").alias("g"),
    )
    sums = written(sums, "line-sums")
    lines = sums.agg(F.sum("times")).first()[0] or 0
    often = sums.where(F.col("times") > lines * FREQUENT).select(*_LINE, *[F.col(c).alias(f"{c}0") for c in "wng"])

    key = document_key(F.col("doc_id"), F.col("text"))
    line = F.col("line")
    rows = texts.select(key.alias("key"), F.posexplode_outer(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.select(
        "key",
        (F.coalesce("pos", F.lit(0)) == 0).cast("long").alias("copies"),
        (line.isNull() | (line == "")).alias("settled"),
        *_line_key(line),
    )
    rows = rows.join(F.broadcast(often), list(_LINE), "left")
    # Rows that need no other line's sum are dealt out evenly and meet none.
    settled = F.col("settled") | F.col("n0").isNotNull()
    rows = rows.select(
        "key",
        "copies",
        F.when(settled, F.xxhash64("key", "h2")).otherwise(F.col("h1")).alias("h1"),
        F.when(~settled, F.col("h2")).alias("h2"),
        "w0",
        "n0",
        "g0",
    )
    rows = rows.join(sums.select(*_LINE, "w", "n", "g").hint("merge"), list(_LINE), "left")
    parts = rows.select("key", "copies", *[F.coalesce(c, f"{c}0", F.lit(0).cast("long")).alias(c) for c in "wng"])
    if most > 1:
        across = texts.select(key.alias("key"), F.explode(_across(F.col("text"), most, buckets)).alias("bucket")).join(gains, "bucket")
        zero = F.lit(0).cast("long")
        parts = parts.unionByName(across.select("key", zero.alias("copies"), zero.alias("w"), F.lit(1).cast("long").alias("n"), F.col("gain").alias("g")))
    sums_of = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("copies", *"wng")])
    one = sums_of.select("key", "copies", *[F.expr(f"{c} div copies").alias(c) for c in "wng"])
    weight = F.when(F.col("n") == 0, F.lit(0).cast("long")).otherwise(F.expr("(g - pmod(g, n)) div n"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key.id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    one = one.select(
        "key",
        F.col("key.id").alias("doc_id"),
        F.col("w").alias("n_words"),
        F.col("n").alias("n_features"),
        weight.alias("weight"),
        (weight + noise).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
    )
    return written(one.drop("copy"), "weighed")


def drawn(weights: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``weights`` with ``rank``: 1, 2, 3, ... for the documents of the draw, null for all others.

    Of the documents with an id and ``least_words`` words or more, ``percent`` of a hundred,
    rounded down, are drawn: those of the highest scores, ties to the smaller id, then by the
    hashes of the text. Equal rows are drawn one by one. ``weights`` is what ``weighed`` gives.
    """
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    number = weights.where(fit).count() * percent // 100
    order = [F.desc("fit"), F.desc("score"), F.asc("doc_id"), F.asc("t1"), F.asc("t2")]
    rows = weights.withColumn("fit", fit).withColumn("t1", F.col("key.t1")).withColumn("t2", F.col("key.t2"))
    placed = _numbered(rows, order)
    rank = F.when(F.col("fit") & (F.col("place") <= number), F.col("place"))
    return placed.select(*weights.columns, rank.cast("long").alias("rank"))


def sampled(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``drawn`` gave a rank, with all their columns; of equal rows all, if any is drawn."""
    key = document_key(F.col("doc_id"), F.col("text"))
    wanted = ranks.where("rank IS NOT NULL").select("key").distinct()
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(wanted, "key", "left_semi").select("row.*")
