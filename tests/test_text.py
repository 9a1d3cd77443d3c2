"""Simplifiers and the edit-distance predicate, edge by edge."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refscope.config import COMMENTS_FIRST_SIMILARITY, SHIPPED_SIMILARITY, Comparison, SimilarityConfig, Simplifier
from refscope.functions.distance import Reach, are_similar
from refscope.functions.text import normalize_whitespace, register_simplifier, remove_comments, simplify
from refscope.operators.dedup import _gram_keys, _grams


def apply(spark, function, value):
    return spark.createDataFrame([(value,)], "t string").select(function(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, ""),
        ("", ""),
        (" a\r\n\tb\rc ", "a b c"),
        ("a\u00a0\u2003b", "a b"),
        ("\n\n", ""),
    ],
)
def test_normalize_whitespace(spark, text, expected):
    assert apply(spark, normalize_whitespace, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        (None, ""),
        ("a // b\nc", "a \nc"),
        ("/// doc\nx", "\nx"),
        ("a /* b\nc */ d", "a  d"),
        ("a // b\rc\nd", "a \nd"),  # a carriage return does not end the comment
        ('u = "http://x";\ny', 'u = "http:\ny'),  # strings are not recognised
        ("/* http://x */ y", "/* http:"),  # the line pass comes first
        ("/* a */ b /* c */", " b "),
    ],
)
def test_remove_comments(spark, text, expected):
    assert apply(spark, remove_comments, text) == expected


def test_chain_order_matters(spark):
    text = "a // b\n  c"
    assert apply(spark, lambda c: simplify(c, SHIPPED_SIMILARITY), text) == "a "
    assert apply(spark, lambda c: simplify(c, COMMENTS_FIRST_SIMILARITY), text) == "a c"


def test_chain_skips_disabled_and_unknown(spark):
    config = SimilarityConfig(
        True, (Simplifier("NoSuchStep", True, 0), Simplifier("WhitespaceNormalizer", False, 1), Simplifier("CommentRemover", True, 2))
    )
    assert apply(spark, lambda c: simplify(c, config), "a  b//c") == "a  b"


def test_registered_simplifier(spark):
    register_simplifier("Upper", F.upper)
    config = SimilarityConfig(True, (Simplifier("Upper"),))
    assert apply(spark, lambda c: simplify(c, config), "ab") == "AB"


def test_settings_section():
    config = SimilarityConfig.from_settings(
        {
            "Enabled": True,
            "Simplifiers": [{"Type": "CommentRemover", "Priority": 2}, {"Type": "WhitespaceNormalizer", "Priority": 1}],
            "Comparisons": [{"Type": "LevenshteinDistanceComparison"}, {"Type": "Other"}],
        }
    )
    assert [s.type for s in config.active_simplifiers()] == ["WhitespaceNormalizer", "CommentRemover"]
    assert [(c.max_distance, c.threshold) for c in config.active_comparisons()] == [(10, 0.8)]
    assert SimilarityConfig.from_settings({}).enabled is False


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def similar(a, b, limit, threshold):
    if a == b:
        return True
    if not a or not b:
        return False
    d = edit_distance(a, b)
    return d <= limit or 1.0 - d / max(len(a), len(b)) >= threshold


PAIRS = [
    ("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("abc", "xyz"), ("abcd", "wxyz"), ("kitten", "sitting"),
    ("a" * 40, "a" * 36 + "bbbb"), ("a" * 40, "a" * 35 + "bbbbb"), ("a" * 40, "a" * 44), ("a" * 40, "a" * 45),
    ("é" * 10, "e" * 10), ("abcdefghij", "abcdefghi"), ("x" * 100, "x" * 90 + "y" * 10), ("x" * 100, "x" * 89 + "y" * 11),
]


@pytest.mark.parametrize("limit, threshold", [(3, 0.9), (10, 0.8), (0, 1.0), (0, 0.9), (2, 0.0)])
def test_similarity_equals_definition(spark, limit, threshold):
    config = SimilarityConfig(True, (), (Comparison(max_distance=limit, threshold=threshold),))
    rows = spark.createDataFrame(PAIRS, "a string, b string").select(
        "a", "b", are_similar(F.col("a"), F.col("b"), config).alias("s")
    )
    for row in rows.collect():
        assert row["s"] == similar(row["a"], row["b"], limit, threshold), row


def test_similarity_off(spark):
    pair = spark.createDataFrame([("a", "a")], "a string, b string")
    for config in (SimilarityConfig(), SimilarityConfig(True)):
        assert pair.select(are_similar(F.col("a"), F.col("b"), config).alias("s")).first()["s"] is False


def test_several_rules_any_accepts(spark):
    config = SimilarityConfig(True, (), (Comparison(max_distance=0, threshold=1.0), Comparison(max_distance=2, threshold=1.0)))
    pair = spark.createDataFrame([("abcd", "abxy")], "a string, b string")
    assert pair.select(are_similar(F.col("a"), F.col("b"), config).alias("s")).first()["s"] is True


text = st.text("abcde", min_size=1, max_size=60)
edits = st.lists(st.tuples(st.integers(0, 80), st.sampled_from("abcdeX"), st.sampled_from("irx")), max_size=12)


@given(text, edits, st.sampled_from([(3, 0.9), (10, 0.8), (0, 0.9), (1, 0.5), (5, 1.0)]))
def test_similar_texts_share_a_signature_key(a, changes, rule):
    chars = list(a)
    for at, char, kind in changes:
        if kind == "i":
            chars.insert(at % (len(chars) + 1), char)
        elif chars and kind == "r":
            chars[at % len(chars)] = char
        elif chars:
            chars.pop(at % len(chars))
    b = "".join(chars)
    reach = Reach(SimilarityConfig(True, (), (Comparison(max_distance=rule[0], threshold=rule[1]),)))
    if b and similar(a, b, *rule):
        nothing = np.zeros(0, dtype=np.uint64)
        for common in (nothing, np.sort(np.concatenate([g for _, g in _grams(a, reach)]))[::3]):
            uses = np.arange(len(common))[::-1] + 40
            sides = [set(_gram_keys(t, reach, common, uses).tolist()) for t in (a, b)]
            assert sides[0] & sides[1]
        starts = np.array(reach.bands(max(len(a), len(b))))
        assert abs(np.searchsorted(starts, len(a), "right") - np.searchsorted(starts, len(b), "right")) <= 1
