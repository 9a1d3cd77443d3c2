import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from refscope.llm import periodic as P
from refscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_lyndon(a):
    out = []
    for i in range(len(a)):
        j = i + 1
        while j < len(a) and a[i:] < a[j:]:
            j += 1
        out.append(j - i)
    return out


def plain_runs(a, least):
    """Every period tried at every place; the smallest period of a stretch comes first."""
    found = {}
    for p in range(1, len(a) // 2 + 1):
        i = 0
        while i + p < len(a):
            s = i
            while i + p < len(a) and a[i] == a[i + p]:
                i += 1
            if i > s and i + p - s >= max(least, 2 * p):
                found.setdefault((s, i + p - s), p)
            i += i == s
    return sorted((s, n, p) for (s, n), p in found.items())


def numbers(words):
    seen = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def test_lyndon_lengths_and_runs_of_short_sequences():
    rng = random.Random(5)
    for _ in range(1500):
        letters = rng.randint(1, 4)
        a = [rng.randrange(letters) for _ in range(rng.randint(0, 40))]
        assert P.lyndon_lengths(a) == plain_lyndon(a)
        for least in (2, 5, 12):
            assert P.runs_of(np.array(a, np.int64), least) == plain_runs(a, least)


def repeating_words(rng):
    words = [b"u%d" % rng.randrange(300) for _ in range(rng.randint(0, 150))]
    for _ in range(rng.randint(0, 3)):
        root = [rng.choice([b"x", b"y", b"u1"]) if rng.random() < 0.5 else b"v%d" % rng.randrange(99) for _ in range(rng.randint(1, 12))]
        at = rng.randint(0, len(words))
        words[at:at] = (root * 50)[: rng.randint(6, 40)]
    return words


def test_words_that_no_run_can_hold_change_nothing():
    rng = random.Random(6)
    for _ in range(800):
        words = repeating_words(rng)
        assert P.runs_of_words(words) == plain_runs(numbers(words), 12)


def test_sums_that_collide_are_looked_at_letter_by_letter(monkeypatch):
    monkeypatch.setattr(P, "_PRIME", 3)
    monkeypatch.setattr(P, "_BASE", 2)
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        assert P.runs_of(np.array(a, np.int64), 2) == plain_runs(a, 2)


@pytest.mark.parametrize("text", ["a " * 30_000, "a b " * 20_000, "x " * 12, "x " * 11])
def test_long_and_shortest(text):
    words = text.encode().split()
    want = [(0, len(words), len(set(words)))] if len(words) >= 12 else []
    assert P.runs_of_words(words) == want
    assert P.collapsed(words, want) == (b" ".join(words[: len(set(words))]) if want else b" ".join(words))


def test_edge_rows_and_clashing_columns(spark, docs):
    again = "one two three " * 5
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, again), (4, again), (None, "é x " * 12), (6, "a\x1cb " * 12)]
    table = docs(rows).withColumn("runs", F.lit("runs")).withColumn("collapsed", F.lit("c"))
    found = P.periodic_runs(table, F.col("text"))
    got = sorted((r.row.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed, r.row.runs) for r in found.collect())
    assert got == [
        (0, 12, ((0, 12, 1),), "é x", "runs"),
        (1, 0, (), "", "runs"),
        (2, 0, (), "", "runs"),
        (3, 0, (), "", "runs"),
        (4, 15, ((0, 15, 3),), "one two three", "runs"),
        (4, 15, ((0, 15, 3),), "one two three", "runs"),
        (6, 12, ((0, 12, 1),), "a\x1cb", "runs"),
    ]
    assert P.periodic_runs(table.limit(0), F.col("text")).count() == 0


def test_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = WORD.findall(doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 700:
            runs = [tuple(r) for r in P.runs_of(np.array(numbers(words)))]
        else:
            runs = plain_runs(numbers(words), 12)
        gone = {i for s, length, p in runs for i in range(s + p, s + length)}
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)]
        want.append((doc.doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), *sha))
    found = QUERIES["op12_periodic_runs"](spark, sf)
    assert [f for f, _ in found.dtypes] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(r[1] > 0 for r in want) > 10
