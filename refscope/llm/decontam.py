"""Benchmark decontamination: exact occurrences of item windows in documents, found by their rarest shingle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import LOWER, UPPER, beside, document_key, let, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at every ASCII character but letters and digits; null has none."""
    # lower() is the same on plain ASCII and much faster there.
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, SEPARATORS), ""), F.array().cast("array<string>"))


#: Words of a shingle; an item of fewer words is its own shingle.
SHINGLE = 3


def item_windows(items: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """``(window, n, items)``: each distinct window's text, its word count and the ids of its items, null ids left out."""
    found = items.select(F.col(id_column).cast("string").alias("item_id"), words(F.col(text_column)).alias("w")).where("size(w) > 0")
    found = found.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("at"))
    found = found.select("item_id", F.slice("w", F.col("at") + 1, F.lit(size)).alias("w"))
    return found.groupBy(F.array_join("w", " ").alias("window")).agg(
        F.first(F.size("w")).alias("n"), F.sort_array(F.collect_set("item_id")).alias("items")
    )


def shingles(w: Column, sizes: list[int]) -> Column:
    """``array<struct(token, at)>``: hashes of all stretches of so many words of a text and where they begin."""

    def of(size: int) -> Column:
        none = F.array().cast("array<int>")
        starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(none)
        return F.transform(starts, lambda at: F.struct(F.xxhash64(F.slice(w, at + 1, size)).alias("token"), at.alias("at")))

    return F.concat(*map(of, sizes))


def prefix_tokens(docs: DataFrame, windows: DataFrame, sizes: list[int], text_column: str) -> DataFrame:
    """``(token, bucket)``: windows under their rarest shingle by count over all documents.

    A document that contains the window contains this shingle, so it is the whole
    prefix that an exact match needs. Windows with a shingle no document has are
    dropped: they occur nowhere. ``bucket`` holds ``(offset, n, window, items)`` of all
    windows of a token.
    """
    shorter = F.least("n", F.lit(SHINGLE))

    def parts_of(size: int) -> DataFrame:
        found = let(F.split("window", " "), lambda w: shingles(w, [size]))
        return windows.where(shorter == size).select("window", F.explode(found).alias("x"))

    parts = reduce(DataFrame.unionByName, map(parts_of, sizes)).select("window", "x.token", F.col("x.at").alias("offset"))
    vocabulary = written(parts.select("token").distinct(), "vocabulary")
    tokens = docs.select(F.explode(let(words(F.col(text_column)), lambda w: shingles(w, sizes))).alias("x")).select("x.token")
    counts = tokens.join(beside(vocabulary), "token", "left_semi").groupBy("token").count()
    counts = written(counts, "counts")
    rarest = (
        parts.join(beside(counts), "token", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token", "offset")).alias("least"))
        .where("least.count > 0")
    )
    held = windows.join(rarest, "window").select("least.token", F.struct("least.offset", "n", "window", "items").alias("held"))
    return held.groupBy("token").agg(F.collect_list("held").alias("bucket"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with its hits: ``(row, doc_id, n_words, n_hit, items)``.

    ``row`` holds the columns of ``docs`` whatever their names. A window is
    ``size`` consecutive words of an item, or the whole item if it is shorter;
    ``n_hit`` counts the document's words inside any occurrence of a window and
    ``items`` lists, as strings in order, the items whose windows occur.

    Windows are looked up by their rarest shingle of ``SHINGLE`` words. The shingle's place
    in the window gives the only place the window can begin; a document too short
    before or after that place is no candidate (length and position bounds). What is
    left is verified word for word in the document, place by place: what is brought to a
    document are its own matching places and the windows of their shingles, and only
    windows that occur become rows of it. Null texts have no words; items without words take
    no part; the windows of items without id hit words as others do, but no id of theirs is
    listed; items that share a window share its row; equal rows are given the same result; empty
    tables give no hits.
    """
    windows = written(item_windows(items, size, item_column, item_text_column), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    key = document_key(F.col(f"`{id_column}`"), F.col(f"`{text_column}`")).alias("key")
    prefixes = written(prefix_tokens(docs, windows, sizes, text_column), "prefixes")
    places = let(words(F.col(f"`{text_column}`")), lambda w: F.struct(F.size(w).alias("n_words"), shingles(w, sizes).alias("x")))
    places = docs.select(key, places.alias("p")).select("key", "p.n_words", F.explode("p.x").alias("x")).select("key", "n_words", "x.*")

    def fits(c):
        begin = F.col("at") - c["offset"]
        return (begin >= 0) & (begin + c["n"] <= F.col("n_words"))

    met = places.join(beside(prefixes), "token").where(F.exists("bucket", fits))
    met = met.groupBy("key", "token").agg(F.collect_set("at").alias("at"), F.first("bucket").alias("bucket"))
    met = met.groupBy("key").agg(F.collect_list(F.struct("at", "bucket")).alias("met"))
    met = written(met, "candidates")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        key,
    )
    # What is met grows with the documents: shuffled whatever its size.
    inside = F.col("row")
    rows = rows.join(met.hint("merge"), "key", "left").select(
        "row", inside.getField(id_column).alias("doc_id"), inside.getField(text_column).alias("text"), "met"
    )
    none = F.array().cast("array<struct<begin:int,n:int,items:array<string>>>")

    def verified(w):
        def of_token(m):
            def at_place(at):
                def occurs(c):
                    begin = at - c["offset"]
                    return (begin >= 0) & (F.array_join(F.slice(w, F.greatest(begin, F.lit(0)) + 1, c["n"]), " ") == c["window"])

                def hit(c):
                    return F.struct((at - c["offset"]).alias("begin"), c["n"].alias("n"), c["items"].alias("items"))

                return F.transform(F.filter(m["bucket"], occurs), hit)

            return F.flatten(F.transform(m["at"], at_place))

        hits = F.coalesce(F.flatten(F.transform("met", of_token)), none)
        return F.struct(F.size(w).cast("long").alias("n_words"), F.array_sort(hits).alias("hits"))

    rows = rows.select("row", "doc_id", let(words(F.col("text")), verified).alias("x")).select("row", "doc_id", "x.n_words", "x.hits")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))

    def cover(seen, hit):
        end = hit["begin"] + hit["n"]
        more = F.greatest(F.lit(0), end - F.greatest(seen["end"], hit["begin"]))
        return F.struct(F.greatest(seen["end"], end).alias("end"), (seen["hit"] + more).cast("long").alias("hit"))

    return rows.select(
        "row",
        "doc_id",
        "n_words",
        F.aggregate("hits", start, cover, lambda seen: seen["hit"]).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"),
    )
