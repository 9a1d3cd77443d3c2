import itertools
import zlib

import numpy as np

from refscope.llm import quality as Q

GOOD = "The quick brown fox jumps over the lazy dog near the old river bank."
BAD = "buy%%% now### cheap*** pills&&& click$$$ here%%%"


def model():
    docs = [(Q.text_lines(f"{GOOD} {i}\n{GOOD}".encode())[0], 1) for i in range(30)]
    docs += [(Q.text_lines(f"{BAD} {i}\n{BAD}".encode())[0], 0) for i in range(30)]
    return Q.train(docs)


def test_marginals_equal_the_sum_over_all_labellings():
    rng = np.random.default_rng(1)
    moves, first = rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([1, 3, 5])
    unary = rng.normal(size=(3, 5))
    good, pairs, total = Q.forward_backward(unary, lengths, moves, first)
    for d, n in enumerate(lengths):
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            s = first[path[0]] + sum(unary[d, t] * y for t, y in enumerate(path))
            weights[path] = np.exp(s + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        z = sum(weights.values())
        assert np.isclose(total[d], np.log(z))
        for t in range(n):
            assert np.isclose(good[d, t], sum(w for p, w in weights.items() if p[t]) / z)
        for t in range(n - 1):
            assert np.isclose(pairs[d, t].sum(), 1)
            assert np.isclose(pairs[d, t, 0, 1], sum(w for p, w in weights.items() if p[t : t + 2] == (0, 1)) / z)
        assert not pairs[d, n - 1 :].any()


def test_lots_do_not_change_scores(monkeypatch):
    texts = [f"{GOOD}\n{BAD}\n{GOOD}".encode() * (1 + i % 4) for i in range(40)] + [None, b"", b"\n \n"]
    found = model()
    want = Q.score_texts(texts, found)
    monkeypatch.setattr(Q, "_LINES_AT_ONCE", 7)
    assert np.allclose(Q.score_texts(texts, found), want)
    assert (want[-3:] == 0).all() and ((0 <= want) & (want <= 1)).all()


def test_a_line_is_judged_beside_its_neighbours():
    found = model()
    assert Q.score_texts([GOOD.encode()], found)[0] > 0.9 > 0.1 > Q.score_texts([BAD.encode()], found)[0]
    among_bad = Q.score_texts([f"{BAD}\n{BAD}\nok now\n{BAD}\n{BAD}".encode()], found)[0]
    assert among_bad < 0.2


def test_held_out_rows_and_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = Q.scored(docs, Q.fit(docs, labels)).select("doc_id", "held_out", "score", "predicted").collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in found)
    new = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(new) > 60 and sum(r.predicted == truth[r.doc_id] for r in new) / len(new) > 0.95


def test_held_out_labels_are_not_used(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    a, b = Q.fit(docs, labels, docs_per_label=40), Q.fit(docs, wrong, docs_per_label=40)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.moves, b.moves)


def test_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    rows = [(1, GOOD), (2, GOOD), (2, GOOD), (None, BAD), (4, None), (5, ""), (6, "x\n" * 50_000)]
    found = Q.scored(docs(rows), Q.fit(docs(rows), labels))
    got = found.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 and r.predicted == 0 for r in got if not (r.row.text or "").strip())
    assert Q.scored(docs([]), Q.fit(docs([]), labels)).count() == 0
    no_label = Q.fit(docs(rows), labels.limit(0))
    assert Q.scored(docs(rows), no_label).where("doc_id = 1").first().score == 0.5


def test_sampled_documents_are_taken_whole(spark, docs, monkeypatch):
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"{GOOD}\n" * 450 + f"{BAD}\n" * 50 if i % 2 else BAD) for i in ids]
    rows[0] = (ids[0], f"{GOOD}\n" * 4000)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", seen.append)
    Q.fit(docs(rows), labels)
    whole = sorted((len(Q.text_lines(t.encode())[0]), i % 2) for i, t in rows)
    assert len(rows[0][1]) > 200_000 and sorted((len(x), y) for x, y in seen[0]) == whole
    Q.fit(docs(rows), labels, lines_per_label=1200)
    assert sorted(len(x) for x, y in seen[1] if y) == [500, 500] and sum(y == 0 for _, y in seen[1]) == sum(i % 2 == 0 for i in ids)
