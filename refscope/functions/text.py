"""Snippet simplifiers: Column -> Column, chained by configured priority."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from refscope.config import SimilarityConfig


def normalize_whitespace(text: Column) -> Column:
    """Every run of (Unicode) white space becomes one space; ends are trimmed."""
    text = F.coalesce(text, F.lit(""))
    # Of a text of one byte a character, as most are, only runs other than one space are touched; the general class is slow.
    ascii_only = F.regexp_replace(text, r"[\t-\r][\t-\r ]*| [\t-\r ]+", " ")
    return F.trim(F.when(F.octet_length(text) == F.char_length(text), ascii_only).otherwise(F.regexp_replace(text, r"(?U)\s+", " ")))


def remove_comments(text: Column) -> Column:
    """Drop ``//`` to the line's end, then ``/* */`` blocks, wherever they stand.

    Strings are not recognised: ``//`` inside a URL counts as a comment. The
    line pass covers ``///`` too and stops at a line feed only, so it takes a
    carriage return with it.
    """
    no_line = F.regexp_replace(F.coalesce(text, F.lit("")), r"//[^\n]*", "")
    return F.regexp_replace(no_line, r"(?s)/\*.*?\*/", "")


SIMPLIFIERS: dict[str, Callable[[Column], Column]] = {
    "WhitespaceNormalizer": normalize_whitespace,
    "CommentRemover": remove_comments,
}


def register_simplifier(name: str, step: Callable[[Column], Column]) -> None:
    """Add a named step; a pandas UDF fits as well as a Column expression."""
    SIMPLIFIERS[name] = step


def simplify(text: Column, config: SimilarityConfig) -> Column:
    """Run the enabled steps in priority order; unknown names are skipped."""
    out = F.coalesce(text, F.lit(""))
    for step in config.active_simplifiers():
        if step.type in SIMPLIFIERS:
            out = SIMPLIFIERS[step.type](out)
    return out
