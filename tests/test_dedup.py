"""Near-duplicate removal against the sequential rule."""

import random
import re

import pytest

from refscope.config import Comparison, SimilarityConfig
from refscope.operators import dedup
from tests.conftest import nested_loops
from tests.test_text import similar

SCHEMA = (
    "job_id string, solution string, project_name string, file_path string, start_line int, end_line int,"
    " usage_type string, symbol_name string, code_text string"
)


def usages(spark, jobs):
    rows = [(j, "s", "p", "f", i, i, "Direct", "x", t) for j, texts in jobs.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def rule(limit, threshold):
    return SimilarityConfig(True, (), (Comparison(max_distance=limit, threshold=threshold),))


def greedy(texts, limit, threshold):
    kept, groups = [], {}
    for t in texts:
        for k in kept:
            if similar(t, k, limit, threshold):
                groups[t] = k
                break
        else:
            kept.append(t)
            groups[t] = t
    return kept, groups


def invented(seed, n, alphabet, low, high):
    pick = random.Random(seed)
    out = []
    for _ in range(n):
        if out and pick.random() < 0.5:
            s = list(pick.choice(out))
            for _ in range(pick.randint(0, max(1, len(s) // 6))):
                s.insert(pick.randrange(len(s) + 1), pick.choice(alphabet))
            out.append("".join(s))
        else:
            out.append("".join(pick.choice(alphabet) for _ in range(pick.randint(low, high))))
    return out


def check(spark, jobs, limit, threshold, groups=False):
    config = rule(limit, threshold)
    got = {j: set() for j in jobs}
    for row in dedup.near_dedup(usages(spark, jobs), config).collect():
        got[row["job_id"]].add((row["start_line"], row["code_text"]))
    for job, texts in jobs.items():
        kept, _ = greedy(texts, limit, threshold)
        assert got[job] == {(texts.index(t), t) for t in kept}
    if groups:
        found = {(r["job_id"], r["text"]): r["kept_text"] for r in dedup.dedup_groups(usages(spark, jobs), config).collect()}
        for job, texts in jobs.items():
            for t, k in greedy(texts, limit, threshold)[1].items():
                assert found[(job, t)] == k


@pytest.mark.parametrize("limit, threshold", [(3, 0.9), (10, 0.8)])
def test_folding_equals_sequential(spark, limit, threshold):
    jobs = {"a": invented(1, 150, "abcdefgh", 0, 40), "b": invented(2, 60, "abc", 0, 12), "c": ["only"]}
    check(spark, jobs, limit, threshold, groups=True)


def test_wide_folds_equal_sequential(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HEAD", 2)
    monkeypatch.setattr(dedup, "WIDE_HEAD", 7)
    monkeypatch.setattr(dedup, "_bucket_round", None)
    jobs = {"a": invented(3, 60, "abcdefgh", 0, 30), "b": invented(6, 25, "abcdef", 5, 20)}
    check(spark, jobs, 3, 0.9, groups=True)


def test_unlike_texts_of_a_large_job_go_to_bucket_rounds(spark, monkeypatch):
    rounds = []
    bucket = dedup._bucket_round
    monkeypatch.setattr(dedup, "_bucket_round", lambda *a: rounds.append(1) or bucket(*a))
    monkeypatch.setattr(dedup, "WIDE_JOB", 100)
    pick = random.Random(9)
    texts = [" ".join(pick.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(pick.randint(3, 9))) for _ in range(400)]
    check(spark, {"a": texts}, 3, 0.9)
    assert rounds


def test_bucket_rounds_equal_sequential(spark, monkeypatch):
    monkeypatch.setattr(dedup, "WIDE_JOB", 0)
    monkeypatch.setattr(dedup, "HEAD", 2)
    monkeypatch.setattr(dedup, "BUCKET_HEAD", 2)
    monkeypatch.setattr(dedup, "BUCKET_HEAD_LIMIT", 8)
    check(spark, {"a": invented(3, 60, "abcdefgh", 0, 30)}, 3, 0.9, groups=True)


def test_hot_group_of_near_copies_takes_few_rounds(spark, monkeypatch):
    """Thousands of texts similar to one another: no all-pairs work, one fold settles them."""
    calls = []
    fold = dedup._fold
    monkeypatch.setattr(dedup, "_fold", lambda *a: calls.append(1) or fold(*a))
    texts = [f"call(value, {i})" for i in range(3000)]
    kept = dedup.near_dedup(usages(spark, {"hot": texts}), rule(4, 0.9)).collect()
    assert [r["code_text"] for r in kept] == ["call(value, 0)"]
    assert len(calls) == 1


def test_result_does_not_depend_on_partitioning(spark):
    df = usages(spark, {"a": invented(4, 80, "abcdef", 5, 25)})
    results = [
        {tuple(r) for r in dedup.near_dedup(df.repartition(n), rule(3, 0.9)).collect()} for n in (1, 7)
    ]
    assert results[0] == results[1]


def test_off_and_without_comparison_change_nothing(spark):
    df = usages(spark, {"a": ["x", "x", "x"]})
    for config in (SimilarityConfig(), SimilarityConfig(True), SimilarityConfig(True, (), (Comparison(enabled=False),))):
        assert dedup.near_dedup(df, config).count() == 3
        assert dedup.exact_dedup(df, config).count() == 3
    assert dedup.exact_dedup(df, rule(3, 0.9)).count() == 1


def test_empty_text_is_similar_to_empty_only(spark):
    check(spark, {"a": ["", "ab", "", "abcdefghijkl"]}, 3, 0.9)


def test_project_and_type_do_not_matter(spark):
    rows = [("j", "s", "p1", "f", 1, 1, "Direct", "x", "same"), ("j", "s", "p2", "g", 9, 9, "Attribute", "y", "same")]
    kept = dedup.near_dedup(spark.createDataFrame(rows, SCHEMA), rule(3, 0.9)).collect()
    assert [r["project_name"] for r in kept] == ["p1"]


def test_heads_are_cut_down_before_the_shuffle(spark):
    index = spark.createDataFrame([("j", 1, 1, 1, 5)], "job_id string, gram bigint, band int, rank bigint, length int")
    plan = dedup._heads(index, 32)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_a_registered_comparison(spark):
    from pyspark.sql import functions as F

    from refscope.functions.distance import COMPARISONS, register_comparison

    register_comparison("SameStart", lambda a, b, r: F.substring(a, 1, r.max_distance) == F.substring(b, 1, r.max_distance))
    try:
        config = SimilarityConfig(True, (), (Comparison("SameStart", max_distance=2),))
        texts = [f"{a}{b}{i}" for i in range(40) for a in "abc" for b in "xyz"]
        groups = {r["text"]: r["kept_text"] for r in dedup.dedup_groups(usages(spark, {"j": texts}), config).collect()}
        first = {}
        for t in texts:
            first.setdefault(t[:2], t)
        assert groups == {t: first[t[:2]] for t in texts}
        kept = dedup.near_dedup(usages(spark, {"j": texts}), config).collect()
        assert sorted(r["code_text"] for r in kept) == sorted(first.values())
        # Beside the edit distance, either may accept.
        both = SimilarityConfig(True, (), (Comparison("SameStart", max_distance=2), Comparison(max_distance=1, threshold=1.0)))
        some = usages(spark, {"j": ["ab1", "ab999", "xb1", "q"]})
        assert sorted(r["code_text"] for r in dedup.near_dedup(some, both).collect()) == ["ab1", "q"]
    finally:
        del COMPARISONS["SameStart"]


def overlap(a, b, threshold):
    x, y = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
    return a == b or bool(x | y) and len(x & y) / len(x | y) >= threshold


@pytest.mark.parametrize(("threshold", "rounds"), [(0.6, False), (0.5, True), (0.8, True)])
def test_shares_of_words(spark, monkeypatch, threshold, rounds):
    if rounds:
        for name, value in (("HEAD", 16), ("WIDE_JOB", 0), ("BUCKET_HEAD", 8), ("BUCKET_HEAD_LIMIT", 64)):
            monkeypatch.setattr(dedup, name, value)
    pick = random.Random(int(threshold * 10))
    words = ["the", "é_1", "of", *[f"w{i}" for i in range(40)]]
    texts = [" ".join(pick.choices(words, weights=[20, 10, 10] + [1] * 40, k=pick.randint(0, 12))) for _ in range(90)] + ["", "!!", "! !", "the the", "the"]
    texts += [t + " w1" for t in texts[:30]]
    jobs = {"a": list(dict.fromkeys(texts)), "b": ["x y z", "x y"], "c": []}
    config = SimilarityConfig(True, (), (Comparison("TokenOverlapComparison", threshold=threshold),))
    kept = {j: set() for j in jobs}
    for row in dedup.near_dedup(usages(spark, jobs), config).collect():
        kept[row["job_id"]].add(row["code_text"])
    groups = {(r["job_id"], r["text"]): r["kept_text"] for r in dedup.dedup_groups(usages(spark, jobs), config).collect()}
    for job, own in jobs.items():
        want = []
        for t in own:
            first = next((k for k in want if overlap(t, k, threshold)), t)
            assert groups[job, t] == first
            if first == t:
                want.append(t)
        assert kept[job] == set(want)


def test_near_dedup_does_not_ask_for_groups(spark, plans):
    dedup.near_dedup(usages(spark, {"j": ["a", "b"]}), rule(3, 0.9)).count()
    assert "met" not in [label for label, _ in plans]
    dedup.dedup_groups(usages(spark, {"j": ["a", "b"]}), rule(3, 0.9)).count()
    assert "met" in [label for label, _ in plans]


@pytest.mark.parametrize("rule_of", [(3, 0.9), (10, 0.8), (1, 0.95), (0, 0.7)])
def test_a_text_is_found_by_few_keys(rule_of):
    """What the earlier of two similar texts shows, the later asks for, whichever grams are frequent; few are shown."""
    import numpy as np

    from refscope.functions.distance import Reach

    config = rule(*rule_of)
    reach, pick = Reach(config), random.Random(5)
    texts = [t for t in invented(7, 160, "abcd", 0, 60) if t]
    grams = np.unique(np.concatenate([g for t in texts for _, g in dedup._grams(t, reach)]))
    common = np.sort(grams[np.array(pick.sample(range(len(grams)), len(grams) // 2))])
    uses = np.array([pick.randint(33, 5000) for _ in common])
    for limit in (2000, 10):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(dedup, "LONG_TEXT", limit)
            keys = dedup._keys_of(texts, reach, common, uses)
        for a, (mark, shown, _) in zip(texts, keys, strict=True):
            assert 0 < len(shown) <= reach.spread(len(a)) + 1
            for b, (other, _, asked) in zip(texts, keys, strict=True):
                if similar(a, b, *rule_of):
                    assert set(shown) & set(asked)
                    assert bin((mark ^ other) & (2**64 - 1)).count("1") <= 4 * reach.cap(max(len(a), len(b)))


def test_keys_of_two_roles(spark):
    """A text is found by few grams and looks for all of its own."""
    from refscope.functions.distance import Reach

    lookup = dedup._gram_lookup(Reach(rule(3, 0.9)))
    text = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHI"
    nodes = spark.createDataFrame([("j", 1, text)], "job_id string, rank bigint, text string")
    roles = [r["role"] for r in dedup._signatures(nodes, lookup).collect()]
    assert (roles.count(1), roles.count(2), len(roles)) == (6, 41, 47)


def test_a_large_job_is_tried_by_a_short_fold(spark, monkeypatch):
    sizes = []
    fold = dedup._fold
    monkeypatch.setattr(dedup, "_fold", lambda *a: sizes.append(a[3]) or fold(*a))
    monkeypatch.setattr(dedup, "WIDE_JOB", 50)
    check(spark, {"a": invented(8, 150, "abcdefgh", 20, 40)}, 3, 0.9, groups=True)
    assert sizes[0] == dedup.TRIAL_HEAD


def test_a_large_job_stays_with_folds_while_they_drop_texts(spark, monkeypatch):
    rounds = []
    bucket = dedup._bucket_round
    monkeypatch.setattr(dedup, "_bucket_round", lambda *a: rounds.append(1) or bucket(*a))
    monkeypatch.setattr(dedup, "WIDE_JOB", 50)
    pick = random.Random(4)
    # The first fold sees copies of one line and two numbers only: it drops some of the numbers, not half of them.
    texts = [f"status of the order {i:02d}" for i in range(14)] + [f"{n} */ end" for n in pick.sample(range(10**5, 10**6), 300)]
    check(spark, {"a": texts}, 3, 0.9)
    assert not rounds


def test_bounds_among_the_lengths_that_occur():
    """Where no partner is longer, a text is found by fewer and longer grams; similar texts still share one."""
    import numpy as np

    from refscope.functions.distance import Reach

    wide, pick = Reach(rule(3, 0.9)), random.Random(11)
    close = wide.among([45, 46, 47, 48], 4_000_000)
    assert (wide.spread(46), close.spread(46), wide.gram(46), close.gram(46)) == (5, 4, 5, 6)
    texts = [t for t in invented(12, 220, "0123456789abcdef", 20, 60) if t]
    uses = np.array([pick.randint(0, 900) for _ in range(dedup.SLOTS)], dtype=float)
    keys = dedup._keys_of(texts, wide.among(sorted({len(t) for t in texts}), 4_000_000), None, uses)
    pairs = 0
    for a, (mark, shown, _) in zip(texts, keys, strict=True):
        for b, (other, _, asked) in zip(texts, keys, strict=True):
            if a != b and similar(a, b, 3, 0.9):
                pairs += 1
                assert set(shown) & set(asked)
                assert bin((mark ^ other) & (2**64 - 1)).count("1") <= 4 * wide.cap(max(len(a), len(b)))
    assert pairs > 50


def test_members_of_buckets_are_rows_of_a_compiled_join(spark, monkeypatch, plans):
    """No bucket is gathered into an array, keys that ask are not stored, and the rounds equal the sequential rule."""
    for name, value in (("WIDE_JOB", 0), ("HEAD", 2), ("BUCKET_HEAD", 4), ("MANY_TEXTS", 0)):
        monkeypatch.setattr(dedup, name, value)
    check(spark, {"a": invented(14, 45, "abcdef", 12, 40)}, 3, 0.9)
    seen = [plan for label, plan in plans if label == "seen"]
    assert seen and all("ShuffledHashJoin" in plan and "collect_list" not in plan for plan in seen)
    assert all("MapInArrow" in plan for plan in seen)
    assert not nested_loops(plans)


def test_words_do_not_move_to_be_counted(spark, monkeypatch, plans):
    """Keys of a share of words are made where the text is: no join brings words their uses, and no word string is shuffled."""
    for name, value in (("HEAD", 4), ("WIDE_JOB", 0)):
        monkeypatch.setattr(dedup, name, value)
    pick = random.Random(16)
    texts = list(dict.fromkeys(" ".join(pick.sample([*(f"w{i}" for i in range(60)), "é", "über_1"], k=pick.randint(4, 11))) for _ in range(60)))
    texts += [f"{t} more" for t in texts[::3] if len(t.split()) > 8]
    config = SimilarityConfig(True, (), (Comparison("TokenOverlapComparison", threshold=0.8),))
    want = []
    for t in texts:
        if not any(overlap(t, k, 0.8) for k in want):
            want.append(t)
    assert len(want) < len(texts)
    assert {r["code_text"] for r in dedup.near_dedup(usages(spark, {"a": texts}), config).collect()} == set(want)
    signatures = [plan for label, plan in plans if label == "signatures"]
    assert signatures and not any("Join" in plan or "Exchange" in plan or "collect_list" in plan for plan in signatures)
