import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from refscope.llm import resample as R
from refscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, most=1, buckets=10_000, seed="2024", percent=10, least=20):
    """The same by whole texts, one after another."""

    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, most)[1])

    s, t = counts(x for _, x in docs), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        words, found = features(text, most)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, words, len(found), weight, score, None])
    fit = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for place, row in enumerate(fit[: percent * len(fit) // 100], 1):
        row[5] = place
    return sorted(map(tuple, rows), key=str)


def rows_of(found):
    return sorted(map(tuple, found.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


TEXTS = [
    "the cat sat on the mat\nthe cat sat on the mat\n\nA cat, the MAT!",
    "one\ntwo\nthree four\n five",
    "zebra zebra zebra " * 10,
    "naïve café Ünder x9",
    "\n\n",
    "",
    None,
    "word\n" * 30,
    "the cat sat on the mat",
]
TARGET = ["the cat sat on a mat", None, "", "two\nthree", "the mat"]


@pytest.mark.parametrize("most", [1, 2, 3])
@pytest.mark.parametrize("frequent", [0.0, 0.001, 1.0])
def test_against_whole_texts(spark, docs, monkeypatch, most, frequent):
    monkeypatch.setattr(R, "FREQUENT", frequent)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, TEXTS[0]), (None, None)]
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    found = R.drawn(R.weighed(docs(rows), target, most, 50), 30, 4)
    assert rows_of(found) == plain(rows, TARGET, most, 50, percent=30, least=4)


def test_repeated_ids_and_rows(spark, docs):
    rows = [(7, TEXTS[0])] * 5 + [(7, TEXTS[2]), (8, TEXTS[2])]
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    found = R.drawn(R.weighed(docs(rows), target), 100, 1)
    got = rows_of(found)
    assert [r[:5] for r in got] == [r[:5] for r in plain(rows, TARGET, least=1, percent=100)]
    assert sorted(r[5] for r in got) == list(range(1, 8))
    kept = R.sampled(docs(rows), R.drawn(R.weighed(docs(rows), target), 50, 1))
    assert kept.columns == docs(rows).columns and 0 < kept.count() <= 7


def test_empty_tables(spark, docs):
    nothing = docs([(1, "a")]).limit(0)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    assert R.drawn(R.weighed(nothing, target)).count() == 0
    rows = [(i, "some words of a text " * 5) for i in range(20)]
    assert rows_of(R.drawn(R.weighed(docs(rows), target.limit(0)))) == plain(rows, [])


def test_no_task_numbers_all_rows(spark, docs):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = docs([(i, f"w{i} " * 25) for i in range(500)])
        weights = R.weighed(rows, spark.createDataFrame([("w1",)], "text string"))
        found = R.drawn(weights, 50)
        parts = found.withColumn("at", F.spark_partition_id()).groupBy("at").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 500


def test_query_against_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = QUERIES["op13_importance_resampling"](spark, sf)
    assert found.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    want = [(r[0], *r[2:]) for r in plain(docs, target)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert any(r[4] for r in want)
