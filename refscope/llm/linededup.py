"""Line de-duplication: repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refscope.llm.common import document_key, let, written

MIN_WORDS = 50


def _digest(lines: str) -> Column:
    return F.struct(F.xxhash64(F.transform(lines, lambda x: x["h1"])).alias("k1"), F.xxhash64(F.transform(lines, lambda x: x["h2"])).alias("k2"))


def line_windows(docs: DataFrame, min_words: int, id_column: str, text_column: str) -> DataFrame:
    """``(key, pick, spot, k1, k2, first, last)``: every smallest window of whole lines with ``min_words`` words.

    A run of at least ``min_words`` words holds, around each of its lines, such a
    window beginning or ending at some line of the run, in every place it
    occurs. ``pick`` is the smallest line hash of the window, its fingerprint, and
    ``spot`` a hash of that line's place. Lines without words do not count.
    """
    key = document_key(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).alias("key")
    lines = docs.select(key, F.posexplode(F.split(F.col(f"`{text_column}`"), "\n")).alias("pos", "line"))
    lines = lines.select(
        "key.*",
        "pos",
        F.xxhash64("line").alias("h1"),
        F.xxhash64("line", F.lit(1)).alias("h2"),
        F.regexp_count("line", F.lit(r"\S+")).alias("w"),
    ).where("w > 0")
    doc = Window.partitionBy("id", "t1", "t2")
    run = doc.orderBy("pos")
    # Equal rows of documents give each line twice.
    lines = lines.withColumn("_before", F.lag("pos").over(run)).where("_before IS NULL OR _before < pos").drop("_before")
    lines = lines.withColumn("e", F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    lines = lines.withColumn("s", F.col("e") - F.col("w")).withColumn("x", F.struct("h1", "h2", "pos"))
    ahead = doc.orderBy("s").rangeBetween(0, min_words - 1)
    back = doc.orderBy("e").rangeBetween(1 - min_words, 0)

    def window(frame, first, last):
        return F.struct(
            F.sum("w").over(frame).alias("words"),
            F.collect_list("x").over(frame).alias("lines"),
            first.alias("first"),
            last.alias("last"),
        )

    lines = lines.select(
        "id", "t1", "t2", "w",
        window(ahead, F.col("pos"), F.max("pos").over(ahead)).alias("ahead"),
        window(back, F.min("pos").over(back), F.col("pos")).alias("back"),
    )
    # A window back from a line that is also the window ahead of its first line is taken once.
    both = F.filter(
        F.array(F.struct(F.lit(False).alias("back"), F.col("ahead").alias("x")), F.struct(F.lit(True).alias("back"), F.col("back").alias("x"))),
        lambda v: (v["x"]["words"] >= min_words) & (~v["back"] | (v["x"]["words"] - F.col("w") >= min_words)),
    )
    lines = lines.select("id", "t1", "t2", F.explode(both).alias("v")).select("id", "t1", "t2", "v.x.*")
    least = F.array_min("lines")
    return lines.select(
        "id", "t1", "t2",
        least["h1"].alias("pick"),
        F.xxhash64("id", "t1", "t2", least["pos"]).alias("spot"),
        _digest("lines").alias("k"),
        "first", "last",
    ).select("id", "t1", "t2", "pick", "spot", "k.*", "first", "last")


def repeated_runs(
    docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(id, t1, t2, runs)``: per document the maximal runs ``(a, b)`` of lines that occur earlier.

    Earlier is by id (null last), then by hashes of the text, then by line. The
    steps: fingerprints that are picked in one place only cannot lie in a repeated
    run and go; the windows around the others are joined by their whole content to
    its first place; all later places are repeats; overlapping and adjoining
    repeats grow together, to both sides, into maximal runs. Lines that belong
    to the first place itself stay where a text repeats within itself.
    """
    windows = written(line_windows(docs, min_words, id_column, text_column), "windows")
    again = windows.groupBy("pick").agg(F.min("spot").alias("a"), F.max("spot").alias("b")).where("a <> b").select("pick")
    anchored = windows.join(again, "pick", "left_semi")
    place = F.struct(F.col("id").isNull().alias("no"), "id", "t1", "t2", "first", "last")
    anchored = written(anchored.select("k1", "k2", place.alias("at")), "anchored")
    firsts = anchored.groupBy("k1", "k2").agg(F.min("at").alias("origin"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = anchored.join(firsts.drop("n"), ["k1", "k2"]).where("at > origin")
    own = (
        F.col("at.id").eqNullSafe(F.col("origin.id")) & (F.col("at.t1") == F.col("origin.t1")) & (F.col("at.t2") == F.col("origin.t2"))
    )
    start = F.when(own, F.greatest(F.col("at.first"), F.col("origin.last") + 1)).otherwise(F.col("at.first"))
    later = later.select("at.id", "at.t1", "at.t2", start.alias("a"), F.col("at.last").alias("b")).where("a <= b")
    doc = Window.partitionBy("id", "t1", "t2").orderBy("a", "b")
    reach = F.max("b").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("_new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1)))
    later = later.withColumn("_run", F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy("id", "t1", "t2", "_run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy("id", "t1", "t2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def without_repeats(
    docs: DataFrame, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Every row of ``docs`` as ``(row, doc_id, kept, n_lines, n_removed)``.

    ``row`` holds the columns of ``docs`` whatever their names, ``kept`` the text
    without the lines of later repeated runs of at least ``min_words`` words. A
    null text stays null with no lines; an empty text has one empty line; rows
    that agree in id and text are one document and keep the same text; an empty
    table gives an empty table.
    """
    runs = written(repeated_runs(docs, min_words, id_column, text_column), "runs")
    # Both sides are shuffled whatever their size: the plan of a small input is that of a large one.
    runs = runs.select(F.struct("id", "t1", "t2").alias("key"), "runs").hint("merge")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        document_key(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).alias("key"),
    )
    # The text moves once, inside its row.
    inside = F.col("row")
    rows = rows.join(runs, "key", "left").select(
        "row", inside.getField(id_column).alias("doc_id"), inside.getField(text_column).alias("text"), "runs"
    )

    def without_runs(lines):
        def gap(i):
            after = F.when(i == 0, F.lit(0)).otherwise(F.get("runs", i - 1)["b"] + 1)
            before = F.when(i == F.size("runs"), F.size(lines)).otherwise(F.get("runs", i)["a"])
            return F.slice(lines, after + 1, F.greatest(before - after, F.lit(0)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), gap)), "\n")

    kept = let(F.split("text", "\n"), without_runs)
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["b"] - r["a"] + 1))
    return rows.select(
        "row",
        "doc_id",
        F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("kept"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )
