import random

from refscope.llm import linededup as L


def plain(rows, min_words):
    """Lines in a smallest window of min_words words, ahead or back of a line, whose content has an earlier place."""
    texts = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=lambda x: (x[0], x[1] or 0))
    places, out = {}, {}
    for no, i, t in texts:
        lines = [(p, x, len(x.split())) for p, x in enumerate(t.split("\n")) if x.split()]
        for a in range(len(lines)):
            for step in (1, -1):
                b, n = a, lines[a][2]
                while n < min_words and 0 <= b + step < len(lines):
                    b += step
                    n += lines[b][2]
                if n >= min_words:
                    lo, hi = min(a, b), max(a, b)
                    places.setdefault(tuple(x for _, x, _ in lines[lo : hi + 1]), set()).add((no, i or 0, lines[lo][0], lines[hi][0], t))
    for found in places.values():
        first = min(found)
        for no, i, a, b, t in found - {first}:
            start = max(a, first[3] + 1) if (no, i, t) == (first[0], first[1], first[4]) else a
            out.setdefault((no, i, t), set()).update(range(start, b + 1))
    return {
        (i, t): "\n".join(x for p, x in enumerate(t.split("\n")) if p not in out.get((no, i or 0, t), ())) for no, i, t in texts
    }


def check(docs, rows, min_words):
    got = L.without_repeats(docs(rows), min_words).collect()
    want = plain(rows, min_words)
    assert len(got) == len(rows)
    for r in got:
        assert r.kept == want.get((r.doc_id, r.row.text)), r.row.text
        assert r.n_lines == (0 if r.row.text is None else r.row.text.count("\n") + 1)


def test_random_lines_against_plain_search(docs):
    rng = random.Random(2)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(9)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    check(docs, rows, 6)


def test_a_passage_goes_from_all_but_its_first_document(docs):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(3, f"own three\n{passage}\nend"), (1, f"{passage}"), (2, f"own two\n{passage}"), (4, "short\nlines\nhere")]
    got = {r.doc_id: r.kept for r in L.without_repeats(docs(rows)).collect()}
    assert got == {1: passage, 2: "own two", 3: "own three\nend", 4: "short\nlines\nhere"}


def test_matches_grow_to_both_sides(docs):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"x\nbefore it\n{long}\nafter it\ny"), (2, f"u\nbefore it\n{long}\nafter it\nv")]
    got = {r.doc_id: r.kept for r in L.without_repeats(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "u\nv"}


def test_edge_cases(docs):
    one = " ".join("w" * 3 for _ in range(60))
    check(docs, [(1, None), (2, ""), (None, one), (5, one), (5, one), (6, "\n\n"), (7, "a b\n" * 400), (8, "a b\n" * 90)], 50)
    check(docs, [], 50)


def test_a_hot_line(docs):
    line = " ".join(f"h{i}" for i in range(55))
    rows = [(i, f"own {i}\n{line}") for i in range(300)]
    got = {r.doc_id: r.kept for r in L.without_repeats(docs(rows)).collect()}
    assert got.pop(0) == rows[0][1] and all(t == f"own {i}" for i, t in got.items())
