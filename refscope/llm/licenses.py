"""License scans: TF-IDF cosine of headers and license files to templates, inherited from the nearest directory."""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil, log, sqrt
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import beside, document_key, written

THRESHOLD = 0.8
#: File names that speak for their directory and what is below it.
LICENSE_FILES = r"(?i)^(licen[cs]e|copying|unlicense)([.-].*)?$"

#: Short notices of well-known licenses by their public identifiers.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}

#: The standard texts, by public identifier; only the driver reads them.
FULL_TEXTS = {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}

SEPARATORS = "[^a-z0-9]+"


def _terms(text: Column) -> Column:
    return F.split(F.lower(text), SEPARATORS)


def _python_terms(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def document_frequencies(
    docs: DataFrame, templates: list[str], text_column: str = "text"
) -> tuple[int, dict[str, int]]:
    """Number of documents, and of those with each word of the templates: one count over all texts."""
    vocabulary = sorted({w for t in templates for w in _python_terms(t)})
    present = F.array_intersect(_terms(F.col(f"`{text_column}`")), F.lit(vocabulary).cast("array<string>"))
    # No word is empty: the empty one counts the documents.
    present = F.concat(F.coalesce(present, F.array().cast("array<string>")), F.array(F.lit("")))
    counts = docs.select(F.explode(present).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    return found.get("", 0), {w: found.get(w, 0) for w in vocabulary}


def weights(
    templates: dict[str, str], n_docs: int, frequencies: dict[str, int]
) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """Inverse document frequencies, and each template as a unit vector."""
    used = {w for text in templates.values() for w in _python_terms(text)}
    idf = {w: log((1 + n_docs) / (1 + frequencies[w])) + 1 for w in used}
    vectors = {}
    for name, text in templates.items():
        words = _python_terms(text)
        raw = {w: words.count(w) * idf[w] for w in set(words)}
        size = sqrt(sum(x * x for x in raw.values()))
        vectors[name] = {w: x / size for w, x in raw.items()}
    return idf, vectors


def anchors(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words of which a line needs one: without them it keeps too little of any template's length.

    The cosine is at most the length of the template's part that the line shares,
    so each template gives its heaviest words until the rest is below the threshold.
    """
    out = set()
    for vector in vectors.values():
        rest = 1.0
        for word, x in sorted(vector.items(), key=lambda p: (-p[1], p[0])):
            if rest < threshold * threshold - 1e-12:
                break
            out.add(word)
            rest -= x * x
    return sorted(out)


def _plain_words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _mentions(text: Column, need: list[str]) -> Column:
    """Whether a text in lower case has one of the words: a quick search first; then whole words."""
    some = F.lit(False)
    for word in need:
        some = some | F.contains(text, F.lit(word))
    return some & F.arrays_overlap(F.split(text, SEPARATORS), F.lit(need))


def lines(docs: DataFrame, key: Column, need: list[str], text_column: str) -> DataFrame:
    """``(key, pos, n_lines, words)`` of every line that has one of the words ``need``."""
    out = docs.select(key.alias("key"), F.posexplode(F.split(F.lower(F.col(f"`{text_column}`")), "\n")).alias("pos", "line"))
    return out.where(_mentions(F.col("line"), need)).select("key", "pos", F.lit(1).alias("n_lines"), _plain_words(F.col("line")).alias("words"))


@dataclass(frozen=True)
class Reach:
    """How far a run may go: see ``reach``."""

    vocabulary: list[str]
    inside: float  # least square weight of a word of some template
    outside: float  # square weight of any other word
    weight: float  # most square weight of a run, counted word by word
    words: int  # most words of a run


def reach(templates: dict[str, str], idf: dict[str, float], unseen: float, threshold: float) -> Reach:
    """Bounds that every run keeps which holds a template's words no more often than the template and reaches the threshold.

    Let t be the template's length. The run's part inside the template is at most
    t long, so the cosine is below the threshold once the square weight of all
    else passes t^2 (1 / threshold^2 - 1): heavy words, such as those of no
    template, end a run soon, and frequent words may surround a notice in large
    number. Words of the vocabulary beyond a template's own repeat after a while,
    and repeats weigh by their square: that bounds their number.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    low = min(idf.values()) ** 2
    weight, within = 0.0, 0
    for text in templates.values():
        words = _python_terms(text)
        rest = sum((words.count(w) * idf[w]) ** 2 for w in set(words)) * (1 / threshold**2 - 1)
        weight = max(weight, sum(idf[w] ** 2 for w in words) + rest)
        within = max(within, len(words) + ceil(sqrt(len(idf) * rest / low)))
    # A margin for rounding of sums.
    return Reach(sorted(idf), low, unseen**2, weight * (1 + 1e-9), within + int(weight / unseen**2))


def _going(parts: Column, limit: Reach) -> Column:
    """How many of the first of ``parts(words, weight)`` a run may hold: all but those past the limit."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("weight"), F.lit(0).alias("words"))

    def step(a: Column, p: Column) -> Column:
        weight, words = a["weight"] + p["weight"], a["words"] + F.size(p["words"])
        fits = (weight <= limit.weight) & (words <= limit.words)
        # Past the limit the weight stays too large, so that no later part fits.
        return F.struct((a["n"] + fits.cast("int")).alias("n"), F.when(fits, weight).otherwise(float("inf")).alias("weight"), F.when(fits, words).otherwise(a["words"]).alias("words"))

    return F.aggregate(parts, start, step, lambda a: a["n"])


def runs(docs: DataFrame, key: Column, need: list[str], limit: Reach, text_column: str) -> DataFrame:
    """``(key, pos, n_lines, words)`` of every run of two lines or more within ``limit`` that has one of the words ``need``.

    Lines without words, such as the frame of a comment, do not count as lines.
    Runs are built around the lines that have a needed word only: each run
    belongs to the first such line in it. ``pos`` is its first line.
    """
    texts = docs.select(key.alias("key"), F.split(F.lower(F.col(f"`{text_column}`")), "\n").alias("lines"))
    texts = texts.where(F.exists("lines", lambda line: _mentions(line, need)))
    # A longer line is in no run, so that the rest of it need not move.
    parts = F.transform("lines", lambda line: F.slice(_plain_words(line), 1, limit.words + 1))
    texts = texts.select("key", F.filter(parts, lambda ws: F.size(ws) > 0).alias("parts")).where(F.size("parts") > 1)
    known = lambda ws: F.size(F.filter(ws, lambda w: w.isin(limit.vocabulary)))
    weight = lambda ws, n: n * limit.inside + (F.size(ws) - n) * limit.outside
    weighed = F.transform("parts", lambda ws: F.struct(ws.alias("words"), weight(ws, known(ws)).alias("weight")))
    # The optimizer moves tests of this column down: no array may be named inside its lambdas.
    at = F.array_compact(F.transform("parts", lambda ws, i: F.when(F.arrays_overlap(ws, F.lit(need)), i + 1)))
    texts = texts.select("key", weighed.alias("weighed"), at.alias("at"))
    # Lines before a line that has a needed word, back to the one before it, nearest first; and those from it on.
    before = F.greatest(F.lit(1), F.coalesce(F.get("at", F.col("k") - 1), F.lit(0)) + 1, F.col("a") - limit.words)
    texts = texts.select("key", "weighed", "at", F.posexplode("at").alias("k", "a"))
    near = texts.select(
        "key", "a", F.reverse(F.slice("weighed", before, F.col("a") - before + 1)).alias("back"), F.slice("weighed", F.col("a"), F.lit(limit.words)).alias("on")
    )
    near = near.select("key", "a", "back", _going(F.col("back"), limit).alias("n_back"), "on", _going(F.col("on"), limit).alias("n_on"))
    near = near.where("n_back > 0").select(
        "key", "a", F.slice("back", F.lit(1), F.col("n_back")).alias("back"), F.slice("on", F.lit(1), F.col("n_on")).alias("on")
    )
    # Each start: ``n`` lines up to the needed one and what follows it.
    begun = near.select("key", "a", "back", "on", F.explode(F.sequence(F.lit(1), F.size("back"))).alias("n"))
    whole = F.concat(F.reverse(F.slice("back", F.lit(2), F.col("n") - 1)), F.col("on"))
    begun = begun.select("key", (F.col("a") - F.col("n") + 1).alias("pos"), "n", whole.alias("near"))
    begun = begun.select("key", "pos", "n", "near", _going(F.col("near"), limit).alias("most"))
    first = F.greatest(F.lit(2), F.col("n"))
    begun = begun.where(F.col("most") >= first).select("key", "pos", "near", F.explode(F.sequence(first, F.col("most"))).alias("n_lines"))
    words = F.flatten(F.transform(F.slice("near", F.lit(1), F.col("n_lines")), lambda p: p["words"]))
    return begun.select("key", "pos", "n_lines", words.alias("words"))


def unit_scores(
    units: DataFrame,
    idf: dict[str, float],
    vectors: dict[str, dict[str, float]],
    unseen: float,
    threshold: float,
    ranks: dict[str, int],
) -> DataFrame:
    """``(key, best)``: per document the best ``(score, i)`` of any of its units, at least ``threshold``.

    All words of a unit weigh; those of no template as words that no document
    has, so prose around a notice lowers its cosine. ``i`` is the negative rank
    of the template's name.
    """
    words = units.select("key", "pos", "n_lines", F.explode("words").alias("word")).groupBy("key", "pos", "n_lines", "word").agg(F.count(F.lit(1)).alias("n"))
    names = sorted(vectors)
    table = [(w, float(idf[w]), *[float(vectors[name].get(w, 0.0)) for name in names]) for w in sorted(idf)]
    schema = "word string, idf double" + "".join(f", v{i} double" for i in range(len(names)))
    # As many rows as the templates have words, whatever the input.
    known = F.broadcast(units.sparkSession.createDataFrame(table, schema))
    weight = F.col("n") * F.coalesce("idf", F.lit(unseen))
    sums = [F.sum(weight * F.coalesce(f"v{i}", F.lit(0.0))).alias(f"d{i}") for i in range(len(names))]
    sums = words.join(known, "word", "left").groupBy("key", "pos", "n_lines").agg(F.sqrt(F.sum(weight * weight)).alias("size"), *sums)
    cosines = [F.struct(F.round(F.col(f"d{i}") / F.col("size"), 6).alias("score"), F.lit(-ranks[name]).alias("i")) for i, name in enumerate(names)]
    found = sums.select("key", F.array_max(F.array(*cosines)).alias("best")).where(F.col("best.score") >= threshold)
    return found.groupBy("key").agg(F.max("best").alias("best"))


def text_scores(
    files: DataFrame,
    key: Column,
    path: Column,
    templates: dict[str, str],
    full_texts: dict[str, str],
    threshold: float,
    text_column: str,
) -> DataFrame:
    """``(key, score, license)``: per document the best cosine of its lines, runs of lines and, of a license file, its whole text."""
    total, frequencies = document_frequencies(files, [*templates.values(), *full_texts.values()], text_column)
    unseen = log(1 + total) + 1
    names = sorted({*templates, *full_texts})
    ranks = {name: i for i, name in enumerate(names)}
    found = []
    if templates:
        idf, vectors = weights(templates, total, frequencies)
        need = anchors(vectors, threshold)
        limit = reach(templates, idf, unseen, threshold)
        units = lines(files, key, need, text_column).unionByName(runs(files, key, need, limit, text_column))
        found.append(unit_scores(units, idf, vectors, unseen, threshold, ranks))
    if full_texts:
        idf, vectors = weights(full_texts, total, frequencies)
        whole = files.where(file_name(path).rlike(LICENSE_FILES))
        whole = whole.select(key.alias("key"), F.lit(0).alias("pos"), F.lit(0).alias("n_lines"), _plain_words(F.lower(F.col(f"`{text_column}`"))).alias("words"))
        found.append(unit_scores(whole, idf, vectors, unseen, threshold, ranks))
    if not found:
        return files.select(key.alias("key"), F.lit(0.0).alias("score"), F.lit("").alias("license")).limit(0)
    best = found[0] if len(found) == 1 else found[0].unionByName(found[1]).groupBy("key").agg(F.max("best").alias("best"))
    name = F.element_at(F.array(*map(F.lit, names)), 1 - F.col("best.i"))
    return best.select("key", F.col("best.score").alias("score"), name.alias("license"))


def directory(path: Column) -> Column:
    """What stands before the last ``/``; empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def nearest(files: DataFrame) -> DataFrame:
    """``(dir, from_dir, license)``: for each directory of ``files`` the license of the nearest one at or above it.

    ``files`` has ``dir, name, score, license``. Only distinct directories are
    spread over their ancestors and joined, so a directory of any number of files
    costs what one of few does.
    """
    own = files.where(F.col("license").isNotNull() & F.col("name").rlike(LICENSE_FILES))
    own = own.groupBy("dir").agg(F.max(F.struct("score", "license")).alias("best"))
    own = own.select(F.col("dir").alias("from_dir"), "best.license")
    parts = F.split("dir", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))),
        lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("from_dir")),
    )
    dirs = files.select("dir").distinct().select("dir", F.explode(above).alias("x")).select("dir", "x.*")
    found = dirs.join(own, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "license")).alias("x"))
    return found.select("dir", "x.from_dir", "x.license")


def scan(
    files: DataFrame,
    path_column: str = "path",
    text_column: str = "text",
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    full_texts: dict[str, str] | None = None,
) -> DataFrame:
    """Every row of ``files`` as ``(row, path, own_license, score, license, inherited_from)``.

    ``row`` holds the columns of ``files`` whatever their names. A file's own
    license is that of the template most like any part of it (TF-IDF cosine at
    least ``threshold``; word weights from all texts; ties to the first name).
    Parts are its lines and its runs of lines, so that wrapped notices count, beside
    ``templates``, and the whole text of a license file beside ``full_texts``. Runs
    end by the weight of what no template holds (``reach``), so no run is left out
    that reaches the threshold and holds a notice once; a notice that is repeated
    is found in the runs around each copy. Lines and whole texts are of any length.
    Prose on the same line lowers a notice's cosine. A file without one has the
    license of the nearest directory, its own or one above it, in which a license
    file has one; of several the best scored. A null or empty text has no license
    of its own, a null path inherits none, repeated rows are judged alike, an
    empty table gives an empty table.
    """
    templates = TEMPLATES if templates is None else templates
    full_texts = FULL_TEXTS if full_texts is None else full_texts
    path, text = F.col(f"`{path_column}`"), F.col(f"`{text_column}`")
    key = document_key(path, text)
    scores = written(text_scores(files, key, path, templates, full_texts, threshold, text_column), "license-scores")
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"), path.alias("path"), key.alias("key"))
    rows = rows.join(beside(scores), "key", "left").withColumn("dir", directory(F.col("path")))
    places = written(rows.where("path IS NOT NULL").select("dir", file_name(F.col("path")).alias("name"), "score", "license").distinct(), "places")
    given = written(nearest(places).withColumnRenamed("license", "given"), "directory-licenses")
    rows = rows.withColumn("dir", F.when(F.col("path").isNotNull(), F.col("dir"))).join(beside(given), "dir", "left")
    inherits = F.col("license").isNull()
    return rows.select(
        "row",
        "path",
        F.col("license").alias("own_license"),
        "score",
        F.coalesce("license", "given").alias("license"),
        F.when(inherits, F.col("from_dir")).alias("inherited_from"),
    )
