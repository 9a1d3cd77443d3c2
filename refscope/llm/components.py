"""Connected components over a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import written

#: Far above the number of rounds any table needs (it grows with the logarithm of the longest chain, squared at worst).
MOST_ROUNDS = 200


def _mark(links: DataFrame) -> tuple:
    """Row count and order-free digest of a table of links."""
    return tuple(
        links.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", F.lit(7), "u"))
        ).first()
    )


def roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; the root is the component's smallest node.

    Each round hangs every node on the smallest node around it, first all larger
    neighbours ("large star"), then all smaller ones ("small star"). Only minima
    and joins by node are used, so a node of any degree is fine, and each round
    is written, so a lost executor costs no earlier round. Nulls and loops are
    ignored; an empty table has no components.
    """
    links = (
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    links = written(links, "links")
    mark = _mark(links)
    for _ in range(MOST_ROUNDS):
        if not mark[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        links = written(links, "links")
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    rooted = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
