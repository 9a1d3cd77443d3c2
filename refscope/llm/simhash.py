"""SimHash near-duplicates: fingerprints linked by a trie self-join under a Hamming budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import bounded_batches, written
from refscope.llm.components import roots

BITS = 64
SEED = 42
#: Fingerprints of one trie node that a task joins on its own; larger nodes are split further first.
NODE_ROWS = 1024
#: Bits by which a larger node is split in one round.
STEP = 4
#: Pairs of fingerprints, at most, that a task looks at together.
PAIRS_AT_ONCE = 1 << 21
_HASHES_AT_ONCE = 1 << 15


def simhash(text: bytes | None, shingle: int) -> int:
    """Fingerprint of one text as an unsigned number; zero without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    count = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(BITS, np.int64)
    for at in range(0, count, _HASHES_AT_ONCE):
        some = min(_HASHES_AT_ONCE, count - at)
        hashes = np.fromiter(
            (digest(joined[s : e - 1], SEED) for s, e in zip(starts[at : at + some], last[at : at + some], strict=True)),
            np.dtype("<u8"),
            some,
        )
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(sums * 2 > count, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int) -> Column:
    """SimHash of whole texts as a signed long; null and blank texts give zero."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            found = np.fromiter((simhash(t, shingle) for t in some), np.uint64, len(some))
            yield pd.Series(found.view(np.int64))

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "long")(F.encode(text, "UTF-8"))


def block_widths(distance: int) -> list[int]:
    """Widths of ``distance + 1`` blocks of a fingerprint, as even as can be."""
    blocks = distance + 1
    return [BITS // blocks + (i < BITS % blocks) for i in range(blocks)]


def budgets(widths: list[int], turn: int) -> list[int]:
    """Differing bits allowed after each bit of a fingerprint turned to begin with block ``turn``.

    If two fingerprints differ in at most ``d`` of all bits, then among the
    ``d + 1`` turns there is one whose first ``n`` blocks together differ in at
    most ``n - 1`` bits, for every ``n``. So each trie allows none in its first
    block, one in the first two, and so on.
    """
    order = widths[turn:] + widths[:turn]
    return [used for used, width in enumerate(order) for _ in range(width)]


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def trie_links(keys, lo1, hi1, lo2, hi2, spent, depth, allowed, distance) -> tuple[np.ndarray, np.ndarray]:
    """Descend into pairs of trie nodes together; index pairs of keys that link them.

    ``keys`` (uint64) are sorted inside every node, a node is a range of them.
    The frontier goes down bit by bit; a pair of nodes is dropped once its
    differing bits exceed what ``allowed`` (by turn and depth) still permits.
    Two single keys are compared at once. If all remaining bits may differ, the
    nodes are linked whole, by as many links as they have keys.
    """
    out_a, out_b = [], []
    turn = allowed[1]
    table = allowed[0]
    while len(lo1):
        # Nodes of one key each: take the distance of what is left.
        n1, n2 = hi1 - lo1, hi2 - lo2
        single = (n1 == 1) & (n2 == 1)
        if single.any():
            a, b = lo1[single], lo2[single]
            near = (_popcount(keys[a] ^ keys[b]) <= distance) & (a != b)
            out_a.append(a[near])
            out_b.append(b[near])
        whole = ~single & (spent + (BITS - depth) <= distance)
        for i in np.flatnonzero(whole):
            some = np.unique(np.r_[lo1[i] : hi1[i], lo2[i] : hi2[i]])
            out_a.append(np.full(len(some) - 1, some[0]))
            out_b.append(some[1:])
        rest = ~single & ~whole
        lo1, hi1, lo2, hi2, spent, depth, turn = (x[rest] for x in (lo1, hi1, lo2, hi2, spent, depth, turn))
        if not len(lo1):
            break
        # The next bit splits a range where its keys turn from 0 to 1: halve the interval of that place.
        mid1 = _split(keys, lo1, hi1, depth)
        mid2 = _split(keys, lo2, hi2, depth)
        same = lo1 == lo2
        down = [
            (lo1, mid1, lo2, mid2, spent, np.ones(len(lo1), bool)),
            (mid1, hi1, mid2, hi2, spent, np.ones(len(lo1), bool)),
            (lo1, mid1, mid2, hi2, spent + 1, np.ones(len(lo1), bool)),
            (mid1, hi1, lo2, mid2, spent + 1, ~same),
        ]
        parts = []
        for a, b, c, e, used, wanted in down:
            keep = wanted & (b > a) & (e > c) & (used <= table[turn, depth])
            parts.append([x[keep] for x in (a, b, c, e, used, depth + 1, turn)])
        lo1, hi1, lo2, hi2, spent, depth, turn = (np.concatenate(x) for x in zip(*parts, strict=True))
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def _split(keys, lo, hi, depth) -> np.ndarray:
    """First place in each sorted range whose bit at ``depth`` (0 is the highest) is set."""
    shift = (BITS - 1 - depth).astype(np.uint64)
    low, high = lo.copy(), hi.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        set_ = ((keys[np.minimum(mid, len(keys) - 1)] >> shift) & np.uint64(1)).astype(bool)
        high = np.where(open_ & set_, mid, high)
        low = np.where(open_ & ~set_, mid + 1, low)


def spanning(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links with the same components as the links ``a``-``b`` over ``size`` places."""
    label = np.arange(size)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        np.minimum.at(label, before[a], label[a])
        np.minimum.at(label, before[b], label[b])
        label = label[label]
        if (label == before).all():
            break
    tied = np.flatnonzero(label != np.arange(size))
    return tied, label[tied]


def _node_links(table: np.ndarray, distance: int):
    """Per partition: rows sorted by node pair, taken node pair by node pair in bounded lots."""
    columns = ["turn", "a", "b", "side", "depth", "spent", "key", "fp"]

    def lot(rows: pd.DataFrame) -> pd.DataFrame:
        turn, a, b, side = (rows[c].to_numpy() for c in columns[:4])
        keys = rows["key"].to_numpy().view(np.uint64)
        first = np.r_[True, (turn[1:] != turn[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        starts = np.flatnonzero(first)
        stops = np.r_[starts[1:], len(rows)]
        middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
        own = a[starts] == b[starts]
        lo2 = np.where(own, starts, middle)
        live = (middle > starts) & (stops > lo2)
        depth, spent = (rows[c].to_numpy()[starts].astype(np.int64) for c in ("depth", "spent"))
        args = [x[live] for x in (starts, middle, lo2, stops, spent, depth)]
        args[3] = np.where(own, middle, stops)[live]
        left, right = trie_links(keys, *args, (table, turn[starts][live].astype(np.int64)), distance)
        tied, hub = spanning(left, right, len(rows))
        fps = rows["fp"].to_numpy()
        return pd.DataFrame({"u": fps[tied], "v": fps[hub]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            cols = [rows[c].to_numpy() for c in columns[:3]]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if len(rows) else []
            bounds = [0, *change]
            at, work = 0, 0
            # The last node pair may go on in the next batch.
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                work += (stop - start) ** 2
                if work >= PAIRS_AT_ONCE:
                    yield lot(rows.iloc[at:stop])
                    at, work = stop, 0
            if bounds[-1] > at:
                yield lot(rows.iloc[at : bounds[-1]])
            kept = rows.iloc[bounds[-1] :].reset_index(drop=True)
        if kept is not None and len(kept):
            yield lot(kept)

    return run


def fingerprint_links(fingerprints: DataFrame, distance: int, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``(u, v)`` that join all fingerprints ``fp`` (distinct longs) within ``distance`` bits.

    The links span the components; not every near pair is among them. The same
    trie is laid out ``distance + 1`` times, each beginning with another block of
    bits (see ``budgets``). A node reached by no differing bit is a group of a
    shuffle; one that holds more than ``node_rows`` fingerprints is split with the
    nodes near it, bit by bit, until each pair of nodes fits into a task. Nothing
    is capped: a node ends at the latest with all bits.
    """
    if not 0 <= distance <= 15:
        raise ValueError("distance must be 0 to 15")
    widths = block_widths(distance)
    table = np.array([budgets(widths, t) for t in range(len(widths))])
    starts = [0, *accumulate(widths)][:-1]
    turned = [
        F.struct(
            F.lit(t).alias("turn"),
            (
                F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", BITS - s)) if s else F.col("fp")
            ).alias("key"),
            F.lit(widths[t]).alias("depth"),
        )
        for t, s in enumerate(starts)
    ]
    node = F.expr("shiftrightunsigned(key, 64 - depth)")
    work = (
        fingerprints.select("fp", F.explode(F.array(*turned)).alias("_t"))
        .select("fp", "_t.*")
        .select(
            "turn", node.alias("a"), node.alias("b"), F.lit(0).alias("side"), "depth", F.lit(0).alias("spent"), "key", "fp"
        )
    )
    pair = ["turn", "a", "b"]
    parts = []
    for _ in range(BITS):
        on = F.col("side") == 0
        sizes = work.groupBy(*pair, "depth", "spent").agg(
            F.count_if(on).alias("left"), F.count_if(~on).alias("right")
        )
        # A pair of unlike nodes one of which is empty has nothing to link; a node of all bits is one fingerprint.
        over = sizes.where(
            (F.greatest("left", "right") > node_rows) & ((F.col("a") == F.col("b")) | (F.least("left", "right") > 0))
        ).where(F.col("depth") < BITS)
        over = written(over.select(*pair, "depth"), "wide-nodes")
        wide = not over.isEmpty()
        small = work.join(over, [*pair, "depth"], "left_anti").select(work.columns) if wide else work
        rows = small.repartition(*pair).sortWithinPartitions(*pair, "side", F.col("key") < 0, "key")
        parts.append(written(rows.mapInPandas(_node_links(table, distance), "u long, v long"), "node-links"))
        if not wide:
            break
        work = written(_deeper(work.join(over, [*pair, "depth"], "left_semi"), table), "nodes")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _deeper(work: DataFrame, table: np.ndarray) -> DataFrame:
    """Rows of wide node pairs, dealt to the pairs of their nodes' descendants ``STEP`` bits below."""
    allowed = F.lit([int(x) for row in table for x in row])
    down = F.least(F.lit(STEP), F.lit(BITS) - F.col("depth"))
    depth = F.col("depth") + down
    rows = work.withColumn("_down", down).withColumn("_to", depth)
    rows = rows.withColumn("_own", F.expr("cast(shiftrightunsigned(key, 64 - _to) & (shiftleft(1, _down) - 1) as int)"))
    rows = rows.withColumn("_may", F.element_at(allowed, F.col("turn") * BITS + F.col("_to")))
    rows = rows.withColumn("_q", F.explode(F.expr("sequence(0, shiftleft(1, _down) - 1)")))
    rows = rows.withColumn("_spent", F.col("spent") + F.bit_count(F.col("_own").bitwiseXOR(F.col("_q"))))
    rows = rows.where("_spent <= _may")

    def below(node: str, bits: Column) -> Column:
        return F.expr(f"shiftleft({node}, _down)").bitwiseOR(bits.cast("long"))

    # A row of a node paired with itself takes the smaller of both descendants first; else each side stays.
    own, other, first = F.col("_own"), F.col("_q"), F.col("side") == 0
    itself = F.col("a") == F.col("b")
    left = F.when(itself, F.least(own, other)).when(first, own).otherwise(other)
    right = F.when(itself, F.greatest(own, other)).when(first, other).otherwise(own)
    return rows.select(
        "turn",
        below("a", left).alias("a"),
        below("b", right).alias("b"),
        F.expr("CASE WHEN a = b THEN IF(_own > _q, 1, 0) ELSE side END").alias("side"),
        F.col("_to").alias("depth"),
        F.col("_spent").cast("int").alias("spent"),
        "key",
        "fp",
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int,
    distance: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id, group)`` for every row of ``docs``.

    Texts become word-shingle SimHashes (``fingerprint``, a long); fingerprints
    at most ``distance`` bits apart are linked, and links are followed to the
    end. ``group`` is the component's smallest fingerprint, ``component_id`` the
    smallest id in it. Equal fingerprints are one node of the search, so copies
    cost nothing. Null, empty and blank texts share fingerprint zero and are
    linked like any other; a null id takes part but names no component (a
    component of null ids only has a null ``component_id``); repeated rows give
    repeated rows; an empty table gives none. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    prints = docs.select(F.col(id_column).alias("doc_id"), fingerprint(F.col(text_column), shingle).alias("fp"))
    prints = written(prints, "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    tied = roots(fingerprint_links(nodes.select("fp"), distance, node_rows))
    named = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("group")
    )
    named = written(named, "rooted")
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(least, "group").select("fp", "group", "component_id")
    return prints.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id", "group")


def keep_one(
    docs: DataFrame, shingle: int, distance: int, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Rows of ``docs``, all columns, one per component: that of the smallest id.

    Among rows of that id the one with the smallest hash of its values stays,
    among equal rows any one; rows without id come last. Columns of any name may
    be present.
    """
    bounded_batches(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(
        row.alias("row"), F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")
    )
    rows = rows.select("row", "doc_id", "text", F.xxhash64("row").alias("digest"))
    found = written(
        rows.select("doc_id", "digest", fingerprint(F.col("text"), shingle).alias("fp")), "prints"
    )
    nodes = written(
        found.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")).alias("first")),
        "fingerprints",
    )
    tied = roots(fingerprint_links(nodes.select("fp"), distance))
    named = nodes.join(tied.withColumnRenamed("node", "fp"), "fp", "left")
    stay = named.groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("first").alias("first"))
    stay = written(stay.select(F.col("first.doc_id").alias("id"), F.col("first.digest").alias("of")), "stay")
    chosen = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))
    out = rows.join(stay, chosen, "left_semi")
    # Unlike rows never share both id and digest; equal rows do, and one of them stays.
    repeated = found.groupBy("doc_id", "digest").count().where("count > 1").join(stay, chosen, "left_semi")
    if not repeated.isEmpty():
        out = out.dropDuplicates(["doc_id", "digest"])
    return out.select("row.*")
