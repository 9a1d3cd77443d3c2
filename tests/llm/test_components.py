import random

from refscope.llm.components import roots


def plain(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in links:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_random_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)]
    links += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(None, 3), (4, None), (-5, -5)]
    rng.shuffle(links)
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == plain(links)


def test_no_links(spark):
    assert roots(spark.createDataFrame([], "u long, v long")).count() == 0
