"""Lines around a usage, out of whole files or out of chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.runtime import cut, fits_broadcast
from refscope.sources.files import is_binary, split_lines

#: Lines in a chunk of the line store.
CHUNK_LINES = 64


def _lines() -> Column:
    """Lines of a file row; a binary or unreadable (null) text has none."""
    none = F.array().cast("array<string>")
    unread = is_binary(F.col("file_path")) | F.col("text").isNull()
    return F.when(unread, none).otherwise(split_lines(F.col("text")))


def _joined(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def snippets(positions: DataFrame, files: DataFrame) -> DataFrame:
    """Snippet for each distinct ``(solution, file_path, start_line, context_lines)``.

    Positions of one file come together in one array (at most one entry per line
    and context size asked for), so a file's text moves once and is split once,
    however many usages it has. Returns the position, ``content``, ``first_line``,
    ``last_line``, ``truncated`` and ``status``.
    """
    key = ["solution", "file_path"]
    asked = cut(
        positions.groupBy(*key).agg(F.collect_set(F.struct("start_line", "context_lines")).alias("asked")),
        "asked",
    )
    texts = files.select(*key, "text", F.lit(True).alias("exists"))
    if fits_broadcast(asked):
        # Few files are asked for: the others' texts are dropped where they are read.
        texts = texts.join(F.broadcast(asked.select(*key)), key, "left_semi")
    # In the file's line array a place only cuts out its text; what is said of it is worked out row by row.
    total, at, around = F.col("total"), F.col("at.start_line"), F.col("at.context_lines")
    here = lambda at: F.struct(*[at[c].alias(c) for c in ("start_line", "context_lines")], _cut_out(at["start_line"], at["context_lines"]).alias("text"))
    return (
        asked.join(texts, key, "left")
        .select(*key, "asked", F.when(F.col("exists"), _lines()).alias("lines"))
        .select(*key, F.when(F.col("lines").isNotNull(), F.size("lines")).alias("total"), F.explode(F.transform("asked", here)).alias("at"))
        .select(*key, _described(total, F.col("file_path"), at, around, F.col("at.text")).alias("snippet"))
        .select(*key, "snippet.*")
    )


def _status(total: Column, at: Column, around: Column) -> Column:
    """Whether there are lines around a place; ``total`` is null for a missing file."""
    return (
        F.when(around < 0, "negative_context")
        .when(at < 1, "bad_line")
        .when(total.isNull(), "missing_file")
        .when(total == 0, "empty_file")
        .when(at > total, "beyond_end")
        .otherwise("ok")
    )


def _bounds(total: Column, at: Column, around: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(1), at - around), F.least(total, at + around)


def _cut_out(at: Column, around: Column) -> Column:
    """The lines around a place out of the file's line array; null where there are none."""
    total = F.size("lines")
    return F.when((around >= 0) & (at >= 1) & (at <= total), _joined(F.col("lines"), *_bounds(total, at, around)))


def _described(total: Column, path: Column, at: Column, around: Column, text: Column) -> Column:
    """A snippet as a struct: ``text``, or what stands in where there are no lines (fixed values)."""
    status = _status(total, at, around)
    low, high = _bounds(total, at, around)
    ok, empty = status == "ok", status == "empty_file"
    content = (
        F.when(ok, text)
        .when(empty, F.lit(""))
        .when(status == "missing_file", F.concat(F.lit("// File not found: "), path))
        .when(
            status == "beyond_end",
            F.concat(
                F.lit("// Target line "), at.cast("string"),
                F.lit(" is beyond file length ("), total.cast("string"), F.lit(" lines)"),
            ),
        )
        .when(
            status == "bad_line",
            F.lit("// Error reading file: Target line must be 1 or greater (Parameter 'targetLine')"),
        )
        .otherwise(F.lit("// Error reading file: Context lines cannot be negative (Parameter 'contextLines')"))
    )
    return F.struct(
        at.alias("start_line"),
        around.alias("context_lines"),
        content.alias("content"),
        F.when(ok, low).when(empty, F.lit(1)).otherwise(at).cast("int").alias("first_line"),
        F.when(ok, high).when(empty, F.lit(1)).otherwise(at).cast("int").alias("last_line"),
        F.when(ok, (at - around < 1) | (at + around > total)).otherwise(~empty).alias("truncated"),
        status.alias("status"),
    )


def chunk_lines(files: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """``(solution, file_path, chunk, size, total, lines)``: files as chunks of ``size`` lines, for a store.

    Chunk 0 is there for every file, also for one without lines; every chunk knows its file's ``total``. Narrow: a
    text is split once, where it is read.
    """
    lines, chunk = F.col("lines"), F.col("chunk")
    last = F.greatest(F.lit(0), F.ceil(F.size(lines) / size).cast("int") - 1)
    return (
        files.select("solution", "file_path", _lines().alias("lines"))
        .select("solution", "file_path", F.size(lines).alias("total"), "lines", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
        .select("solution", "file_path", "chunk", F.lit(size).alias("size"), "total", F.slice(lines, chunk * size + 1, F.lit(size)).alias("lines"))
    )


def snippets_of_chunks(positions: DataFrame, chunks: DataFrame) -> DataFrame:
    """As ``snippets``, out of ``chunk_lines``: a position meets the chunks its lines lie in, mostly one or two.

    Whether there are lines is told by each file's chunk 0, of which no line is read. The places then meet their chunks
    by number, so the work on one file of any length spreads over as many keys as it has chunks.
    """
    key, place = ["solution", "file_path"], ["solution", "file_path", "start_line", "context_lines"]
    at, around, total = F.col("start_line"), F.col("context_lines"), F.col("total")
    heads = chunks.where(F.col("chunk") == 0).select(*key, "size", "total")
    placed = cut(positions.select(*place).distinct().join(heads, key, "left"), "placed")
    low, high = _bounds(total, at, around)
    chunk_of = lambda line: F.floor((line - 1) / F.col("size")).cast("int")
    wanted = placed.where(_status(total, at, around) == "ok").select(
        *place, low.alias("low"), high.alias("high"), F.explode(F.sequence(chunk_of(low), chunk_of(high))).alias("chunk")
    )
    start = F.col("chunk") * F.col("size")
    first = F.greatest(F.col("low") - start, F.lit(1))
    piece = F.struct("chunk", _joined(F.col("lines"), first, F.least(F.col("high") - start, F.col("size"))).alias("text"))
    met = wanted.join(chunks.select(*key, "chunk", "size", "lines"), [*key, "chunk"]).select(*place, piece.alias("piece"))
    texts = met.groupBy(*place).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: x["text"]), "\n")
    found = placed.join(texts, place, "left").select(*key, _described(total, F.col("file_path"), at, around, text).alias("snippet"))
    return found.select(*key, "snippet.*")


def attach_context(usages: DataFrame, files: DataFrame) -> DataFrame:
    """Replace ``code_text`` by the lines around ``start_line`` where ``context_lines`` > 0.

    Positions are reduced to distinct ones before any text moves. ``has_context``
    is true only for real lines; the stand-in texts are kept. ``files`` are whole
    files or, with a column ``chunk``, the stored chunks of ``chunk_lines``.
    """
    find = snippets_of_chunks if "chunk" in files.columns else snippets
    wanted = F.col("context_lines") > 0
    key = ["solution", "file_path", "start_line", "context_lines"]
    found = find(usages.where(wanted).select(*key), files)
    hit = F.col("status").isNotNull()
    return usages.join(found, key, "left").select(
        *[
            c
            for c in usages.columns
            if c not in ("code_text", "context_start_line", "context_end_line", "has_context")
        ],
        F.when(hit, F.col("content")).otherwise(F.col("code_text")).alias("code_text"),
        F.when(hit, F.col("first_line")).otherwise(F.lit(0)).alias("context_start_line"),
        F.when(hit, F.col("last_line")).otherwise(F.lit(0)).alias("context_end_line"),
        F.coalesce(F.col("status") == "ok", F.lit(False)).alias("has_context"),
    )


def context_of_every_line(files: DataFrame, context_lines: int) -> DataFrame:
    """Context of all lines at once. Narrow: each file yields its own rows, nothing is shuffled."""
    lines = F.col("lines")

    def around(_: Column, i: Column) -> Column:
        low = F.greatest(F.lit(1), i + 1 - context_lines)
        high = F.least(F.size(lines), i + 1 + context_lines)
        return F.struct((i + 1).alias("line_no"), _joined(lines, low, high).alias("content"))

    return (
        files.select("solution", "file_path", _lines().alias("lines"))
        .select("solution", "file_path", F.explode(F.transform(lines, around)).alias("at"))
        .select("solution", "file_path", "at.line_no", "at.content")
    )


def marked_context(usages: DataFrame) -> DataFrame:
    """Printable block: ``>>>`` marks the usage's own lines, numbers are four wide.

    Applies to usages with context of more than one line; others keep their text.
    """

    def line(text: Column, i: Column) -> Column:
        number = F.col("context_start_line") + i
        digits = number.cast("string")
        inside = (number >= F.col("start_line")) & (number <= F.col("end_line"))
        return F.concat(
            F.when(inside, ">>>").otherwise("   "),
            F.lit(" "),
            F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit(" ")),
            F.lit(": "),
            text,
        )

    block = F.array_join(F.transform(split_lines(F.col("code_text")), line), "\n")
    many = F.col("has_context") & F.col("code_text").contains("\n")
    return usages.withColumn("printed", F.when(many, block).otherwise(F.concat(F.lit("Code: "), F.col("code_text"))))
