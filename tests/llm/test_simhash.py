import random

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from refscope.llm import simhash as S

MASK = (1 << 64) - 1


def plain_fingerprint(text, k):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \n\té .", max_size=60), st.integers(1, 5))
def test_fingerprint_is_the_majority_of_shingle_hashes(text, k):
    assert S.simhash(text.encode(), k) == plain_fingerprint(text, k)


def test_fingerprint_of_a_long_text():
    words = [f"w{random.Random(i).randrange(9)}" for i in range(70_000)]
    assert S.simhash(" ".join(words).encode(), 4) == plain_fingerprint(" ".join(words), 4)


@pytest.mark.parametrize("distance", range(0, 9))
def test_some_turn_keeps_its_budgets(distance):
    rng = random.Random(distance)
    widths = S.block_widths(distance)
    assert sum(widths) == 64
    for _ in range(300):
        bits = set(rng.sample(range(64), rng.randint(0, distance)))
        kept = False
        for turn in range(len(widths)):
            start = sum(widths[:turn])
            table, spent = S.budgets(widths, turn), 0
            for at in range(64):
                spent += (start + at) % 64 in bits
                if spent > table[at]:
                    break
            else:
                kept = True
        assert kept


@pytest.mark.parametrize(("distance", "node_rows"), [(4, 1024), (4, 6), (2, 3)])
def test_links_span_all_near_fingerprints(spark, distance, node_rows):
    rng = random.Random(distance + node_rows)
    base = [rng.getrandbits(64) for _ in range(6)] + [0, MASK]
    values = set()
    while len(values) < 400:
        v = rng.choice(base)
        for _ in range(rng.randint(0, 8)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = plain_components(values, distance)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for u, v in S.fingerprint_links(df, distance, node_rows).collect():
        assert want[u & MASK] == want[v & MASK]
        x, y = find(u & MASK), find(v & MASK)
        root[max(x, y)] = min(x, y)
    assert {v: find(v) for v in values} == want


TEXT = "one two three four five six seven eight nine ten"


def test_components_and_edge_cases(spark, docs):
    rows = [(5, TEXT), (3, TEXT.upper()), (9, "other words are found here not there"), (None, TEXT), (7, None), (6, ""), (8, " \n"), (5, TEXT)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(docs(rows), 4, 4).collect()}
    value = S.simhash(TEXT.encode(), 4)
    value -= (1 << 64) if value >> 63 else 0
    assert {(i, c) for i, f, c in got if f == value} == {(5, 3), (3, 3), (None, 3)}
    assert {(i, c) for i, f, c in got if f == 0} == {(7, 6), (6, 6), (8, 6)}
    assert S.near_duplicates(docs(rows), 4, 4).count() == len(rows)
    assert S.near_duplicates(docs([]), 4, 4).count() == 0


def test_one_row_of_each_component_stays(spark, docs):
    rows = [(5, TEXT), (5, TEXT), (4, "quite another text about nothing at all"), (None, "a b c d e"), (None, "a b c d e"), (7, None), (2, None)]
    kept = S.keep_one(docs(rows), 4, 4)
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect() if r.doc_id) == [
        (False, 2, None), (False, 4, rows[2][1]), (False, 5, TEXT)
    ]
    assert kept.where("doc_id IS NULL").count() == 1
    assert S.keep_one(docs([]), 4, 4).count() == 0


def test_a_hot_group_of_near_copies_is_one_component(spark, docs):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(own)))
    found = S.near_duplicates(docs(rows), 4, 4, node_rows=8).collect()
    want = plain_components([r.fingerprint & MASK for r in found], 4)
    least = {}
    for r in found:
        least[want[r.fingerprint & MASK]] = min(least.get(want[r.fingerprint & MASK], r.doc_id), r.doc_id)
    assert all(r.component_id == least[want[r.fingerprint & MASK]] for r in found)
