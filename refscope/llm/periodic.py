"""Stretches of words that repeat with a period: runs, found from Lyndon roots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import bounded_batches

#: Shortest run in words; a run also holds its period twice.
LEAST_WORDS = 12
#: Words of the grams that tell where no run can be.
_GRAM = 4
#: A prime below 2**31 and a number below it, for comparing stretches; what they find equal is compared in full.
_PRIME, _BASE = (1 << 31) - 1, 1_050_011_357
_MIX = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


def lyndon_lengths(letters: Sequence[int]) -> list[int]:
    """Length of the longest Lyndon word that starts at each place.

    Phase one of Baier's suffix sorter. Suffixes are grouped by their first letter.
    From the highest group to the lowest, each suffix of a group points to the
    nearest place to its left that is in a lower group. What a place was known to
    begin with grows by the group's prefix, as often as suffixes of the group point
    to it, and it moves into a new group right above its old one. The prefix of
    the group in which a place is at last met is its longest Lyndon word.
    """
    n = len(letters)
    ranks = sorted(set(letters))
    at = {letter: g for g, letter in enumerate(ranks)}
    group = [at[x] for x in letters]
    members: list[list[int]] = [[] for _ in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [1] * len(ranks)
    below = list(range(-1, len(ranks) - 1))
    above = list(range(1, len(ranks) + 1))
    # ``left[i + 1]`` leads to the nearest place at or before i that is not met yet; 0 is none.
    left = list(range(n + 1))
    out = [0] * n
    now = len(ranks) - 1
    while now >= 0:
        met = [i for i in members[now] if group[i] == now]
        members[now] = []
        for i in met:
            left[i + 1] = i
            out[i] = size[now]
        pointed: dict[int, int] = {}
        for x in met:
            while left[x] != x:
                left[x] = left[left[x]]
                x = left[x]
            if x:
                pointed[x] = pointed.get(x, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for x, times in pointed.items():
            moved.setdefault((times, group[x - 1]), []).append(x - 1)
        for times, old in sorted(moved, reverse=True):
            new = len(members)
            places = moved[times, old]
            members.append(places)
            size.append(size[old] + times * size[now])
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = below[over] = new
            for j in places:
                group[j] = new
        now = below[now]
    return out


class _Stretches:
    """Lengths of equal stretches to the right and to the left of pairs of places."""

    def __init__(self, letters: np.ndarray):
        n = len(letters)
        powers = np.ones(1, np.int64)
        while len(powers) <= n:
            step = powers[-1] * _BASE % _PRIME
            powers = np.concatenate([powers, powers * step % _PRIME])
        self.n, self.powers = n, powers
        self.sums = np.concatenate([[0], np.cumsum((letters + 1) * powers[:n] % _PRIME) % _PRIME])

    def _equal(self, i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
        one = (self.sums[i + size] - self.sums[i]) % _PRIME
        two = (self.sums[j + size] - self.sums[j]) % _PRIME
        return one * self.powers[j - i] % _PRIME == two

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the stretches that begin at i and at j, i < j, are equal."""
        out = np.zeros(len(i), np.int64)
        for bit in reversed(range(self.n.bit_length())):
            fits = np.flatnonzero(j + out + (1 << bit) <= self.n)
            same = fits[self._equal(i[fits] + out[fits], j[fits] + out[fits], 1 << bit)]
            out[same] += 1 << bit
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the stretches that end before i and before j, i < j, are equal."""
        out = np.zeros(len(i), np.int64)
        for bit in reversed(range(self.n.bit_length())):
            fits = np.flatnonzero(i - out >= 1 << bit)
            same = fits[self._equal(i[fits] - out[fits] - (1 << bit), j[fits] - out[fits] - (1 << bit), 1 << bit)]
            out[same] += 1 << bit
        return out


def _extended(letters: np.ndarray, i: int, period: int) -> tuple[int, int]:
    """First place and end of the widest stretch around i with a period, letter by letter."""
    differ = np.flatnonzero(letters[:-period] != letters[period:])
    after = np.searchsorted(differ, i)
    first = int(differ[after - 1]) + 1 if after else 0
    end = int(differ[after]) + period if after < len(differ) else len(letters)
    return first, end


def runs_of(letters: np.ndarray, least: int = LEAST_WORDS) -> list[Run]:
    """All runs of ``max(least, 2 * period)`` letters or more: start, length and smallest period, by start.

    Every run holds a Lyndon word, under one of the two orders of the letters, of
    the length of its period that is the longest at its place. So each place gives
    a root per order, which grows to both sides as far as its period holds.
    """
    n = len(letters)
    if n < max(least, 2):
        return []
    place = np.arange(n)
    roots = [np.array(lyndon_lengths(order.tolist())) for order in (letters, -letters)]
    i = np.concatenate([place, place])
    period = np.concatenate(roots)
    inside = i + period < n
    i, period = i[inside], period[inside]
    stretches = _Stretches(letters)
    first = i - stretches.left(i, i + period)
    end = i + period + stretches.right(i, i + period)
    long = end - first >= np.maximum(least, 2 * period)
    # Roots of one run name it alike, so each run is verified once.
    named: dict[Run, list[int]] = {}
    for a, b, p, at in zip(first[long].tolist(), end[long].tolist(), period[long].tolist(), i[long].tolist()):
        named.setdefault((a, b, p), []).append(at)
    found = set()
    for (a, b, p), places in named.items():
        if np.array_equal(letters[a : b - p], letters[a + p : b]):
            found.add((a, b - a, p))
            continue
        # Different stretches of equal sums: seen only here, so look at the letters around each root.
        for at in places:
            a, b = _extended(letters, at, p)
            if b - a >= max(least, 2 * p):
                found.add((a, b - a, p))
    return sorted(found)


def _candidates(words: list[bytes], least: int) -> list[tuple[int, int]]:
    """Stretches, first place and end, that hold every run; all else is of words that no run can hold.

    In a run each gram comes again a period before or after, but for at most
    ``_GRAM - 1`` grams one after another in its middle. So where ``_GRAM`` grams in a
    row are the only ones of their kind, no run covers all of them. Two such
    stretches share fewer words than the shortest run, so none is found twice.
    """
    n = len(words)
    whole = [(0, n)] if n >= least else []
    if n < least or least < 2 * _GRAM:
        return whole
    codes = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
    grams = codes[: n - _GRAM + 1].copy()
    for k in range(1, _GRAM):
        grams = grams * np.uint64(_MIX) + codes[k : n - _GRAM + 1 + k]
    order = np.sort(grams)
    again = np.isin(grams, order[1:][order[1:] == order[:-1]])
    if again.all():
        return whole
    # Two different grams of one hash only make a stretch longer.
    since = np.cumsum(np.concatenate([[0], ~again]))
    alone = np.flatnonzero(since[_GRAM:] - since[:-_GRAM] == _GRAM)
    edges = np.concatenate([[-1], alone, [n - 2 * _GRAM + 2]])
    first, end = edges[:-1] + 1, edges[1:] + 2 * _GRAM - 2
    long = end - first >= least
    return list(zip(first[long].tolist(), end[long].tolist()))


def runs_of_words(words: list[bytes], least: int = LEAST_WORDS) -> list[Run]:
    """As ``runs_of``, for words; equal words are equal letters."""
    found: list[Run] = []
    for first, end in _candidates(words, least):
        numbers: dict[bytes, int] = {}
        letters = np.array([numbers.setdefault(w, len(numbers)) for w in words[first:end]], np.int64)
        found += [(first + start, length, period) for start, length, period in runs_of(letters, least)]
    return found


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, one space between, without those that any run holds after its first period."""
    if runs:
        steps = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            steps[start + period] += 1
            steps[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, text: Column, least: int = LEAST_WORDS) -> DataFrame:
    """Every row as struct ``row``, with the runs of its text and the text without their repeats.

    ``n_words``: words of the text, stretches of characters other than the six ASCII
    white spaces. ``runs``: array of ``struct(start, length, period)``, in words from
    0, by start and then period. ``collapsed``: the words that stay, one space between.

    A null text has no words, no runs and an empty ``collapsed``, as has an empty or blank
    one. Equal rows are worked out alike, each for itself; other columns play no
    part. A text is worked on whole, by the task that reads it: memory grows
    with the longest text and, within it, with the stretches that repeat.
    """
    bounded_batches(docs.sparkSession)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            rows = []
            for raw in some:
                words = bytes(raw).split() if raw is not None else []
                runs = runs_of_words(words, least)
                rows.append((len(words), runs, collapsed(words, runs)))
            yield pd.DataFrame(
                {
                    "n_words": pd.Series([n for n, _, _ in rows], dtype="int64"),
                    "starts": pd.Series([[s for s, _, _ in r] for _, r, _ in rows], dtype=object),
                    "lengths": pd.Series([[n for _, n, _ in r] for _, r, _ in rows], dtype=object),
                    "periods": pd.Series([[p for _, _, p in r] for _, r, _ in rows], dtype=object),
                    "collapsed": pd.Series([k for _, _, k in rows], dtype=object),
                }
            )

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = "n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed binary"
    found = F.pandas_udf(run, kind).asNondeterministic()(text.cast("binary"))
    whole = docs.select(F.struct("*").alias("row"), found.alias("f"))
    runs = F.transform(
        F.arrays_zip(F.col("f.starts").alias("start"), F.col("f.lengths").alias("length"), F.col("f.periods").alias("period")),
        lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period")),
    )
    return whole.select("row", "f.n_words", runs.alias("runs"), F.col("f.collapsed").cast("string").alias("collapsed"))
