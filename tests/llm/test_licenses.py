from math import log, sqrt

from pyspark.sql import functions as F

from refscope.llm import licenses as L


def scan(spark, rows, **more):
    df = spark.createDataFrame(rows, "path string, text string").withColumn("dir", F.lit("d")).withColumn("row", F.lit(1)).withColumn("score", F.lit(1))
    return L.scan(df, **more)


def test_licenses_and_inheritance(spark):
    mit, apache = L.TEMPLATES["MIT"], L.TEMPLATES["Apache-2.0"]
    rows = [
        ("LICENSE", f"intro\n{mit}"), ("a/b/x.txt", "plain"), ("a/LICENSE.md", apache.upper()), ("a/b/c/copying", "not a license"),
        ("a/b/c/y.txt", f"text\n{L.TEMPLATES['GPL-3.0']}\nmore"), ("b/z.txt", None), ("ab/q.txt", ""), (None, mit), (None, "none"),
        ("a/b/x.txt", "plain"), ("a/b/long.txt", "word " * 100_000 + mit),
    ]
    got = {(r.path, (r.row.text or "")[:20]): (r.own_license, r.license, r.inherited_from) for r in scan(spark, rows).collect()}
    assert got["LICENSE", "intro\nReleased under"] == ("MIT", "MIT", None)
    assert got["a/b/x.txt", "plain"] == (None, "Apache-2.0", "a")
    assert got["a/LICENSE.md", apache.upper()[:20]] == ("Apache-2.0", "Apache-2.0", None)
    assert got["a/b/c/copying", "not a license"] == (None, "Apache-2.0", "a")
    assert got["a/b/c/y.txt", "text\nThis work is li"] == ("GPL-3.0", "GPL-3.0", None)
    assert got["b/z.txt", ""] == got["ab/q.txt", ""] == (None, "MIT", "")
    assert got[None, mit[:20]] == ("MIT", "MIT", None) and got[None, "none"] == (None, None, None)
    assert got["a/b/long.txt", "word word word word "] == (None, "Apache-2.0", "a")
    assert scan(spark, rows).count() == len(rows) and scan(spark, []).count() == 0


def test_scores_equal_a_plain_cosine(spark):
    texts = ["licensed under the apache license", "released under mit license now", "the the license", "gnu general public license version 2 or 3", "apache", ""]
    templates = {"A": "Licensed under the Apache License", "B": "GNU General Public License, version 2"}
    words = [t.split() for t in texts]
    vocabulary = {w for t in templates.values() for w in t.lower().replace(",", "").split()}
    idf = {w: log((1 + len(texts)) / (1 + sum(w in x for x in words))) + 1 for w in vocabulary}
    unseen = log(1 + len(texts)) + 1

    def vector(ws):
        return {w: ws.count(w) * idf.get(w, unseen) for w in ws}

    def cosine(a, b):
        size = sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return round(sum(x * b.get(w, 0) for w, x in a.items()) / size, 6) if size else 0

    for threshold in (0.3, 0.8):
        got = {r.row.text: (r.own_license, r.score) for r in scan(spark, [(f"p{i}", t) for i, t in enumerate(texts)], templates=templates, threshold=threshold).collect()}
        for t, w in zip(texts, words, strict=True):
            best = max((cosine(vector(w), vector(x.lower().replace(",", "").split())), n) for n, x in templates.items())
            assert got[t] == ((best[1], best[0]) if best[0] >= threshold else (None, None)), t


def _plain_best(texts, path, text, threshold=0.8):
    """Best (score, name) over all runs of lines, of any length, and a license file's whole text."""
    import re

    words = [set(re.findall("[a-z0-9]+", (t or "").lower())) for t in texts]
    unseen = log(1 + len(texts)) + 1

    def best(units, templates):
        bags = {n: re.findall("[a-z0-9]+", t.lower()) for n, t in templates.items()}
        idf = {w: log((1 + len(texts)) / (1 + sum(w in x for x in words))) + 1 for b in bags.values() for w in set(b)}

        def vector(ws):
            return {w: ws.count(w) * idf.get(w, unseen) for w in set(ws)}

        sides = {n: vector(b) for n, b in bags.items()}
        for unit in units:
            v = vector(unit)
            for n, t in sides.items():
                if v:
                    yield round(sum(x * t.get(w, 0) for w, x in v.items()) / sqrt(sum(x * x for x in v.values()) * sum(x * x for x in t.values())), 6), n

    rows = [re.findall("[a-z0-9]+", line) for line in (text or "").lower().split("\n")]
    parts = [sum(rows[a : b + 1], []) for a in range(len(rows)) for b in range(a, len(rows))]
    found = list(best(parts, L.TEMPLATES))
    if re.match(L.LICENSE_FILES, path.rsplit("/", 1)[-1]):
        found += best([sum(rows, [])], L.FULL_TEXTS)
    score, name = min(((-s, n) for s, n in found), default=(0, None))
    return (name, -score) if -score >= threshold else (None, None)


def test_full_texts_and_wrapped_notices(spark):
    gpl, apache, cc = L.TEMPLATES["GPL-3.0"], L.TEMPLATES["Apache-2.0"], L.TEMPLATES["CC-BY-4.0"]
    rows = [(f"full/{name}/LICENSE", f"Copyright (c) 2020 Some One\n\n{text}") for name, text in L.FULL_TEXTS.items()]
    rows += [
        ("w/two.c", "/* Some words before.\n * " + gpl.replace("GNU General ", "GNU General\n * ") + "\n */\nint main;"),
        ("w/words.py", "prose goes here\n" + "\n#\n# ".join(apache.split()) + "\nand more prose"), ("w/crlf.txt", cc.replace("under ", "under\r\n")),
        ("w/prose.txt", "one two three four\nfive six seven the license\n\nversion 2"), ("w/none.txt", None), ("w/empty.txt", "\n\n"),
        ("full/MIT/no.txt", L.FULL_TEXTS["MIT"]), ("w/long.txt", ("word " * 30 + "\n") * 2000 + "Released under the\nMIT License.\n" + "word " * 30),
    ]
    texts = [t for _, t in rows]
    got = {r.path: r for r in scan(spark, rows).collect()}
    for name in L.FULL_TEXTS:
        assert got[f"full/{name}/LICENSE"].own_license == name
    assert [got[f"w/{n}"].own_license for n in ("two.c", "words.py", "crlf.txt", "long.txt")] == ["GPL-3.0", "Apache-2.0", "CC-BY-4.0", "MIT"]
    assert got["full/MIT/no.txt"].own_license is None and got["full/MIT/no.txt"].inherited_from == "full/MIT"
    for path, text in rows:
        if len(text or "") < 2000:
            assert (got[path].own_license, got[path].score) == _plain_best(texts, path, text), path
    assert {r.own_license for r in scan(spark, rows, full_texts={}).where("path LIKE 'full/%'").collect()} <= {None, *L.TEMPLATES}


def test_notices_between_many_frequent_words(spark):
    """Words that most texts have weigh little: a notice among many of them counts, wherever its lines break."""
    common = "this is the work under public software and is free to the public under general domain".split()
    apache = "licensed under the apache license version 2 0".split()
    rows = [(f"plain/{i}", " ".join(common)) for i in range(300)]
    broken = [(f"n/{i}", " ".join(common[:9] + apache[:i]) + "\n" + " ".join(apache[i:] + common[6:15])) for i in range(1, 8)]
    broken += [("n/words", "\n".join(common[:9] + apache + common[6:])), ("n/one", " ".join(common[:9] + apache + common[6:15]))]
    texts = [t for _, t in rows + broken]
    got = {r.path: r for r in scan(spark, rows + broken).collect()}
    for path, text in broken:
        assert got[path].own_license == "Apache-2.0", path
        assert (got[path].own_license, got[path].score) == _plain_best(texts, path, text), path
    assert {got[p].own_license for p, _ in rows} == {None}


def test_runs_of_one_frequent_line_are_few(spark):
    """A line repeated many times gives each start a bounded number of runs, and an unlike word ends them."""
    words = {w: 1.0 for t in L.TEMPLATES.values() for w in L._python_terms(t)}
    limit = L.reach(L.TEMPLATES, words, 10.0, 0.8)
    docs = spark.createDataFrame([(1, "license\n" * 500), (2, "license\nx y z\nlicense"), (3, "license\nthe\nthe x\nlicense")], "id int, text string")
    got = L.runs(docs, F.col("id"), ["license"], limit, "text").groupBy("key").agg(F.count("*").alias("n"), F.max("n_lines").alias("most"), F.countDistinct("pos", "n_lines").alias("kinds")).collect()
    got = {r.key: r for r in got}
    assert all(r.n == r.kinds for r in got.values())
    assert got[1].most <= limit.weight and got[1].n <= 500 * limit.weight
    assert 2 not in got and got[3].n == 1
