"""Similarity predicates and the bounds candidate search relies on."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from copy import copy
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.config import Comparison, SimilarityConfig


# Slots by which uses of words and grams are counted.
SLOTS = 1 << 18
HAIR = 1e-9


def _cap(longer: Column, rule: Comparison) -> Column:
    """The largest distance at which a pair with this longer length is similar, in the very arithmetic of the ratio."""
    near = F.floor(F.lit(1.0 - rule.threshold) * longer).cast("int")
    fits = lambda d: F.lit(1.0) - d.cast("double") / longer >= F.lit(rule.threshold)
    by_ratio = F.when(fits(near + 1), near + 1).when(fits(near), near).otherwise(near - 1)
    return F.greatest(F.lit(rule.max_distance), F.least(by_ratio, longer))


def _rule(a: Column, b: Column, rule: Comparison) -> Column:
    longer = F.greatest(F.char_length(a), F.char_length(b))
    shorter = F.least(F.char_length(a), F.char_length(b))
    cap = _cap(longer, rule)
    # Beyond the cap the distance is told as -1: one look at it is enough.
    return (
        F.when(a == b, True)
        .when(shorter == 0, False)
        .when(longer - shorter > cap, False)
        .otherwise(F.call_function("levenshtein", a, b, cap) >= 0)
    )


def _marks(hashes: Column) -> Column:
    """64 bits, of which each of the hashes sets one."""
    one = F.lit(1).cast("bigint")
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda bits, h: bits.bitwiseOR(F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))))


def _measured(text: Column, rule: Comparison) -> tuple[Column, Column, Column]:
    """A text's length, the largest distance to a text that is not longer, and marks of its pairs of neighbours."""
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, F.size(chars)), lambda a, b: F.xxhash64(a, b))
    cap = F.when(text != "", _cap(F.char_length(text), rule)).otherwise(F.lit(rule.max_distance))
    return F.char_length(text), cap, _marks(pairs)


def _rule_of(
    a: Column, b: Column, n: Column, m: Column, cap: Column, other: Column, marks: Column, others: Column, rule: Comparison
) -> Column:
    """``_rule`` of two measured texts: caps grow with the length, so the greater one is the longer text's.

    An edit replaces at most two pairs of neighbours by two others.
    """
    most = F.greatest(cap, other)
    some = (n > 0) & (m > 0) & (F.abs(n - m) <= most) & (F.bit_count(marks.bitwiseXOR(others)) <= 4 * most)
    return (some & (F.call_function("levenshtein", a, b, most) >= 0)) | (a == b)


def tokens(text: Column) -> Column:
    """Distinct words of a text: runs of letters, digits and underscores. The general classes are slow, and most texts need none."""
    plain = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), 0)
    general = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.array_distinct(F.when(F.octet_length(text) == F.char_length(text), plain).otherwise(general))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda word: F.xxhash64(word))


def word_hashes(text: Column) -> Column:
    return _hashes(tokens(text))


def _unshared(n: Column, m: Column, threshold: float) -> Column:
    """Words that only one of two similar texts of ``n`` and ``m`` words has: at most so many."""
    return F.lit((1 - threshold) / (1 + threshold)) * (n + m) + HAIR


def _overlap(a: Column, b: Column, rule: Comparison) -> Column:
    """Equal texts, or texts whose shared words are at least ``threshold`` of all their words."""
    return (a == b) | _share(tokens(a), tokens(b), rule)


def _share(words: Column, others: Column, rule: Comparison) -> Column:
    shared = F.size(F.array_intersect(words, others))
    ratio = shared.cast("double") / F.nullif(F.size(words) + F.size(others) - shared, F.lit(0))
    return F.coalesce(ratio >= F.lit(rule.threshold), F.lit(False))


def _words(text: Column, rule: Comparison) -> tuple[Column]:
    """A text's words, found once, and marks of them."""
    marked = lambda words: F.struct(words.alias("words"), _marks(_hashes(words)).alias("marks"))
    return (F.get(F.transform(F.array(tokens(text)), marked), 0),)


def _overlap_of(a: Column, b: Column, one: Column, other: Column, rule: Comparison) -> Column:
    words, others = one["words"], other["words"]
    few = F.bit_count(one["marks"].bitwiseXOR(other["marks"])) <= _unshared(F.size(words), F.size(others), rule.threshold)
    return (a == b) | (few & _share(words, others, rule))


@dataclass(frozen=True)
class Lookup:
    """How texts that may be similar find each other without comparing all pairs.

    ``length`` of a text and ``near``, whether two lengths allow similar texts;
    ``bands``, start lengths of bands so wide that similar texts lie in the same or in
    adjacent ones; ``keys``, from ``(job_id, rank, length, band, text)`` to ``(job_id, rank,
    length, band, gram, place)``, of which two similar texts share at least one ``gram``; and
    ``fits``, whether a key's places in two texts allow these to be similar, given lengths and places of both:
    true for at least one shared key of any similar pair. ``keys`` may add ``role``: 1 for a key under which
    a text is found by later ones, 2 for one under which it looks for earlier ones, 0 for both. ``of_role`` then gives
    the keys of one role alone; settings worked out of the first table it sees hold for all later ones.
    """

    length: Callable[[Column], Column]
    near: Callable[[Column, Column], Column]
    bands: Callable[[int], list[int]]
    keys: Callable[[DataFrame], DataFrame]
    fits: Callable[[Column, Column, Column, Column], Column] = lambda n, p, m, q: F.lit(True)
    of_role: Callable[[DataFrame, int], DataFrame] | None = None


def slot_uses(hashes: DataFrame) -> np.ndarray:
    """How often the hashes of a table's one column fall on each of ``SLOTS`` slots: what is frequent shows, at a bounded size."""
    name = hashes.columns[0]
    counted = hashes.groupBy(F.col(name).bitwiseAND(SLOTS - 1).cast("int").alias("slot")).agg(F.count("*").alias("uses"))
    return _slots_of(counted)


def _slots_of(counted: DataFrame) -> np.ndarray:
    found = counted.toPandas()
    uses = np.zeros(SLOTS)
    uses[found["slot"].to_numpy(np.int64)] = found["uses"].to_numpy(np.float64)
    return uses


def _rarest_words(words: pa.ListArray, threshold: float, uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' hashes of each text those of its prefix, whose texts they are, and marks of all words of each text."""
    ends = words.offsets.to_numpy().astype(np.int64)
    hashes, ends = words.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], ends - ends[0]
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    marks = np.zeros(len(sizes), dtype=np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        marks[some] = np.bitwise_or.reduceat(np.left_shift(np.int64(1), hashes & 63), ends[:-1][some])
    order = np.lexsort((hashes, uses[hashes & (SLOTS - 1)], owner))
    shown = sizes - np.ceil(sizes * threshold - HAIR).astype(np.int64) + 1
    taken = order[np.arange(len(hashes)) - ends[:-1][owner] < shown[owner]]
    return hashes[taken], owner[taken], marks


def _overlap_lookup(rule: Comparison) -> Lookup:
    """Prefix and length bounds of a share of words, and marks of the words.

    Texts with n words that share enough of them share one of the n - ceil(t * n) + 1
    words that are rarest over all texts. Any order of the words that is the same for all texts does: uses are counted
    by slots, so that no word has to move.
    """
    t = rule.threshold

    def bands(longest: int) -> list[int]:
        starts = [0, 1]
        while starts[-1] <= longest and t > 0:
            starts.append(math.floor(starts[-1] / t + HAIR) + 1)
        return starts

    def keys(nodes: DataFrame) -> DataFrame:
        held = ["job_id", "rank", "length", "band"]
        uses = slot_uses(nodes.select(F.explode(word_hashes(F.col("text"))).alias("word")))
        words = nodes.select(*held, word_hashes(F.col("text")).alias("words"))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                grams, owner, marks = _rarest_words(batch.column("words"), t, uses)
                columns = [batch.column(name).take(pa.array(owner)) for name in held]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(grams), pa.array(marks[owner])], [*held, "gram", "place"])

        kinds = dict(nodes.dtypes)
        return words.mapInArrow(rows, ", ".join(f"{name} {kinds[name]}" for name in held) + ", gram bigint, place bigint")

    def fits(n: Column, p: Column, m: Column, q: Column) -> Column:
        return F.bit_count(p.bitwiseXOR(q)) <= _unshared(n, m, t)

    return Lookup(
        length=lambda text: F.size(tokens(text)),
        near=lambda a, b: F.least(a, b) >= F.lit(t) * F.greatest(a, b) - HAIR,
        bands=bands,
        keys=keys,
        fits=fits,
    )


# Comparisons by name: whether two simplified texts are similar under a rule's settings, and how similar texts are
# found. Those without a lookup are settled by folds alone.
COMPARISONS: dict[str, Callable[[Column, Column, Comparison], Column]] = {
    "LevenshteinDistanceComparison": _rule,
    "TokenOverlapComparison": _overlap,
}
LOOKUPS: dict[str, Callable[[Comparison], Lookup]] = {"TokenOverlapComparison": _overlap_lookup}
# What is worked out once per text, and the comparison of two texts by it.
FORMS: dict[str, tuple[Callable, Callable]] = {
    "LevenshteinDistanceComparison": (_measured, _rule_of),
    "TokenOverlapComparison": (_words, _overlap_of),
}


def register_comparison(
    name: str, similar: Callable[[Column, Column, Comparison], Column], lookup: Callable[[Comparison], Lookup] | None = None
) -> None:
    """Add a named, symmetric comparison; equal texts must be similar under it.

    With ``lookup``, jobs of many unlike texts find their candidates by its keys.
    """
    COMPARISONS[name] = similar
    LOOKUPS.pop(name, None)
    FORMS.pop(name, None)
    if lookup:
        LOOKUPS[name] = lookup


def are_similar(a: Column, b: Column, config: SimilarityConfig) -> Column:
    """True if any enabled comparison accepts the two (already simplified) texts."""
    rules = config.active_comparisons()
    if not config.enabled or not rules:
        return F.lit(False)
    return reduce(lambda x, y: x | y, [COMPARISONS[r.type](a, b, r) for r in rules])


def form(text: Column, config: SimilarityConfig) -> Column:
    """A text with all that its comparisons work out of it alone, for many comparisons of one text."""
    rules = enumerate(config.active_comparisons())
    known = [part.alias(f"f{i}_{j}") for i, r in rules if r.type in FORMS for j, part in enumerate(FORMS[r.type][0](text, r))]
    return F.struct(text.alias("text"), *known)


def forms_similar(a: Column, b: Column, config: SimilarityConfig) -> Column:
    """``are_similar`` of two texts given by their ``form``."""

    def by(i: int, r: Comparison) -> Column:
        if r.type in FORMS:
            count = len(FORMS[r.type][0](F.lit(""), r))
            known = [text[f"f{i}_{j}"] for j in range(count) for text in (a, b)]
            return FORMS[r.type][1](a["text"], b["text"], *known, r)
        return COMPARISONS[r.type](a["text"], b["text"], r)

    return reduce(lambda x, y: x | y, [by(i, r) for i, r in enumerate(config.active_comparisons())])


class Reach:
    """Integer bounds on edit distance by text length, over all enabled rules.

    ``cap(n)``    largest distance at which a pair with longer length n can be similar
    ``spread(n)`` largest such distance over every possible partner of a text of
                  length n that is at least as long
    ``gram(n)``   gram length used when the shorter text has length n; 0 if even
                  single characters cannot rule anything out
    """

    MAX_GRAM = 5

    def __init__(self, config: SimilarityConfig):
        rules = config.active_comparisons()
        self.lengths: list[int] | None = None
        self.longest_gram = self.MAX_GRAM
        self.distance = max((r.max_distance for r in rules), default=0)
        self.threshold = min((r.threshold for r in rules), default=1.0)

    def cap(self, n: int) -> int:
        near = math.floor((1.0 - self.threshold) * n)
        by_ratio = max(d for d in (near - 1, near, near + 1) if d < near or not n or 1.0 - d / n >= self.threshold)
        return max(self.distance, min(n, by_ratio))

    def spread(self, n: int) -> int:
        if self.threshold <= 0.0:
            return max(n, 1) * (1 << 20)
        longest = max(math.ceil((n + 1) / self.threshold) + 1, n + self.distance)
        if self.lengths is not None:
            at = bisect_right(self.lengths, longest)
            longest = max(n, self.lengths[at - 1] if at else 0)
        return self.cap(longest)

    def among(self, lengths: list[int], texts: int) -> Reach:
        """The bounds where ``lengths``, in order, are all that occur. More ``texts`` are told apart by longer grams."""
        closer = copy(self)
        closer.lengths = lengths
        closer.longest_gram = max(self.MAX_GRAM, math.ceil(math.log2(texts) / 4))
        return closer

    def bands(self, longest: int) -> list[int]:
        """Start lengths of bands so wide that partners lie in the same or in adjacent bands."""
        starts = [0]
        while starts[-1] <= longest:
            starts.append(starts[-1] + self.spread(starts[-1]) + 1)
        return starts

    def gram(self, n: int) -> int:
        return min(self.longest_gram, n // (self.spread(n) + 1))

    def grams(self, n: int) -> list[int]:
        """The gram length of every text that a text of length n may be similar to."""
        if self.threshold <= 0.0:
            return [0]
        low, high = max(1, n - self.cap(n)), max(math.ceil((n + 1) / self.threshold) + 1, n + self.distance)
        if self.lengths is None:
            return sorted({self.gram(m) for m in range(low, high + 1)})
        return sorted({self.gram(m) for m in self.lengths[bisect_left(self.lengths, low) : bisect_right(self.lengths, high)]})
