"""Near-duplicate removal: keep a row iff it is similar to no earlier kept row.

Rows are taken in the total order ``USAGE_ORDER`` within a job. The result is
the sequential greedy result, computed without comparing all pairs:

1. Equal simplified texts collapse to their first row, before anything else.
2. A *fold* settles the first ``HEAD`` undecided texts of every job in one
   bounded array per job and then drops every later text similar to a kept one.
   Groups of near copies, however large, vanish as soon as one of them is kept.
3. Where folding no longer halves the work, the texts are unlike each other. If
   no job has many of them, wider folds finish them all. Else, where a fold drops
   next to nothing, a *bucket round* looks for candidates by shared signatures: grams for the edit distance, rare
   words for a share of words, whatever a registered comparison names. Each bucket shows only its
   first few undecided members, as rows of a hash join, so a round emits a bounded number of candidates
   per text. A text may be kept only if no bucket hides an earlier member from
   it; the others wait for the next round.

Both steps are exact, so they can follow each other in any order.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refscope.config import SimilarityConfig
from refscope.functions import distance
from refscope.functions.distance import FORMS, LOOKUPS, SLOTS, Lookup, Reach, _slots_of, are_similar, form, forms_similar
from refscope.functions.text import simplify
from refscope.runtime import BROADCAST_ROWS, cut, fits_broadcast, join_bounded, spread, written_rows
from refscope.schemas import USAGE_ORDER

HEAD = 64
# Jobs of more than ``WIDE_JOB`` texts that have a lookup are tried by a fold of ``TRIAL_HEAD`` first.
TRIAL_HEAD = 16
# A job of at most ``WIDE_JOB`` undecided texts that are unlike each other is finished by folds of ``WIDE_HEAD``.
WIDE_HEAD = 1024
WIDE_JOB = 12_000
# Larger jobs stay with folds as long as one drops a text for so many of its comparisons: a bucket round costs more a text.
FOLD_WORTH = 512
BUCKET_HEAD = 32
BUCKET_HEAD_LIMIT = 512
LONG_TEXT = 2_000
# Of so many texts the lengths are counted first: fewer and longer grams will do where no partner is longer.
MANY_TEXTS = 100_000
# Characters whose grams are worked out at once, and keys that a task of a bucket round holds, about.
CHARACTERS = 1_000_000
TASK_KEYS = 500_000

# The signature helper travels with its task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(distance)


def exact_groups(usages: DataFrame, config: SimilarityConfig, order: list[str] = USAGE_ORDER) -> DataFrame:
    """One row per (job, simplified text): its first row in order and its size.

    A minimum of strings is found by sorting the groups. Their hash leads the key: it is compared at a fraction of
    the cost of names and texts, which mostly begin alike.
    """
    first = F.struct(*order, *[c for c in usages.columns if c not in order and c != "job_id"])
    return (
        usages.withColumn("_text", simplify(F.col("code_text"), config))
        .groupBy(F.xxhash64("job_id", "_text").alias("_hash"), "job_id", F.col("_text").alias("text"))
        .agg(F.min(first).alias("first"), F.count("*").alias("copies"))
        .drop("_hash")
    )


def exact_dedup(usages: DataFrame, config: SimilarityConfig, order: list[str] = USAGE_ORDER) -> DataFrame:
    """Keep the first row of each simplified text.

    Only an enabled comparison can call two rows similar: without one, even
    equal copies stay.
    """
    if not config.enabled or not config.active_comparisons():
        return usages
    return _rows(exact_groups(usages, config, order), usages.columns)


def near_dedup(usages: DataFrame, config: SimilarityConfig, order: list[str] = USAGE_ORDER) -> DataFrame:
    """The greedy near-duplicate filter over every job at once."""
    if not config.enabled or not config.active_comparisons():
        return usages
    nodes, kept, _ = _resolve(usages, config, order)
    return _rows(_of(nodes, kept), usages.columns)


def dedup_groups(usages: DataFrame, config: SimilarityConfig, order: list[str] = USAGE_ORDER) -> DataFrame:
    """For every distinct text of a job: the earliest kept text similar to it.

    Columns ``job_id, text, kept_text, copies``; a kept text points at itself.
    """
    if not config.enabled or not config.active_comparisons():
        groups = exact_groups(usages, config, order)
        return groups.select("job_id", "text", F.col("text").alias("kept_text"), "copies")
    nodes, kept, absorbed = _resolve(usages, config, order, groups=True)
    absorbed = kept.select("rank", F.col("rank").alias("kept_rank")).unionByName(absorbed)
    open_ranks = cut(nodes.select("rank").join(absorbed, "rank", "left_anti"), "seekers")
    if not open_ranks.isEmpty():
        absorbed = absorbed.unionByName(_absorb(nodes, kept, open_ranks, config))
    names = nodes.select(F.col("rank").alias("kept_rank"), F.col("text").alias("kept_text"))
    return (
        nodes.select("rank", "job_id", "text", "copies")
        .join(absorbed, "rank")
        .join(names, "kept_rank")
        .select("job_id", "text", "kept_text", "copies")
    )


def similar_pairs(pairs: DataFrame, left: str, right: str, config: SimilarityConfig) -> DataFrame:
    """Add ``similar`` to given pairs of raw texts: both are simplified, then compared."""
    a, b = simplify(F.col(left), config), simplify(F.col(right), config)
    return (
        pairs.withColumn("_a", a)
        .withColumn("_b", b)
        .withColumn("similar", are_similar(F.col("_a"), F.col("_b"), config))
        .drop("_a", "_b")
    )


def _rows(groups: DataFrame, columns: list[str]) -> DataFrame:
    return groups.select("job_id", "first.*").select(*columns)


def _resolve(
    usages: DataFrame, config: SimilarityConfig, order: list[str], groups: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Number the distinct texts in order and split off the kept ones (by ``rank``).

    The third table, asked for by ``groups``, is ``(rank, kept_rank)`` of the texts
    dropped by folds before any bucket round: folds keep texts in order, so
    what drops a text there is its earliest similar kept text. For comparisons
    without a lookup folds do all the work.
    """
    lookup = _lookup(config)
    texts = exact_groups(usages, config, order)
    # The sorted position identifies a text and orders it; it is written at once,
    # so no later recomputation can number the texts differently.
    nodes = cut(
        texts.orderBy("job_id", "first").withColumn("rank", F.monotonically_increasing_id()),
        "nodes",
    )
    undecided = spread(nodes.select("job_id", "rank", "text"))
    left = written_rows(nodes)
    kept: list[DataFrame] = []
    absorbed: list[DataFrame] = []
    signatures = None
    shown = BUCKET_HEAD
    head = HEAD
    trial = lookup is not None and left > WIDE_JOB and _largest_job(undecided) > WIDE_JOB
    while left > 0:
        size, trial = min(head, TRIAL_HEAD) if trial else head, False
        kept_now, undecided, dropped = _fold(undecided, config, groups and signatures is None, size)
        kept.append(kept_now)
        absorbed += dropped
        after = undecided.count()
        unlike = after > left // 2
        if unlike and head == HEAD and _largest_job(undecided) <= WIDE_JOB:
            head = WIDE_HEAD
            undecided = cut(spread(undecided), "undecided")
        elif unlike and head == HEAD and lookup and _dropped(left, undecided, after, size) * FOLD_WORTH < left * size:
            texts = spread(undecided)
            if signatures is None:
                lengths = _lengths(texts, lookup)
                # Where roles differ, the keys that texts look for others by are many: they are worked out anew, not stored.
                live = signatures = cut(_signatures(texts, lookup, lengths, 1), "signatures")
            else:
                live = signatures.join(undecided.select("rank"), "rank", "left_semi")
            asked = _signatures(texts, lookup, lengths, 2) if lookup.of_role else live
            tasks = _tasks(signatures)
            kept_now, undecided = _bucket_round(undecided, _shown(live), _asked(asked), config, lookup, shown, lengths, tasks)
            kept.append(kept_now)
            shown = min(shown * 2, BUCKET_HEAD_LIMIT)
            after = undecided.count()
        left = after
    out = nodes.select("rank").where(F.lit(False))
    for part in kept:
        out = out.unionByName(part)
    by = nodes.select("rank", F.col("rank").alias("kept_rank")).where(F.lit(False))
    for part in absorbed:
        by = by.unionByName(part)
    return nodes, out, by


def _of(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept nodes. Of many, most of them kept, none moves: the others are told to all tasks."""
    if written_rows(nodes) > BROADCAST_ROWS:
        gone = cut(nodes.select("rank").join(kept, "rank", "left_anti"), "gone")
        if fits_broadcast(gone):
            return nodes.join(F.broadcast(gone), "rank", "left_anti")
    return nodes.join(kept, "rank", "left_semi")


def _largest_job(undecided: DataFrame) -> int:
    counts = undecided.groupBy("job_id").agg(F.count("*").alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _dropped(left: int, undecided: DataFrame, after: int, size: int) -> int:
    """Texts a fold has dropped besides those it settled one by one, ``size`` of each job that goes on."""
    return left - after - size * undecided.select("job_id").distinct().count()


def _fold(
    undecided: DataFrame, config: SimilarityConfig, groups: bool, size: int
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Settle the first ``size`` undecided texts of each job and drop what they suppress.

    With ``groups`` the third result tells by which kept text each one is dropped.
    """
    # Forms hold what lengths allow; a registered comparison without one may have a lookup that tells it.
    lookup = None if all(rule.type in FORMS for rule in config.active_comparisons()) else _lookup(config)
    length = lookup.length if lookup else lambda text: F.lit(0)
    near = lookup.near if lookup else lambda a, b: F.lit(True)
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("rank"))
    heads = (
        undecided.withColumn("place", place)
        .where(F.col("place") <= size)
        .groupBy("job_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", length(F.col("text")).alias("n"), form(F.col("text"), config).alias("form")))).alias("head"))
    )

    def add(kept: Column, item: Column) -> Column:
        clash = F.exists(kept, lambda k: near(item["n"], k["n"]) & forms_similar(item["form"], k["form"], config))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(item)))

    nothing = F.filter("head", lambda item: F.lit(False))
    settled = cut(
        heads.select(
            "job_id",
            F.aggregate("head", nothing, add).alias("kept"),
            F.element_at("head", -1)["rank"].alias("upto"),
        ),
        "fold",
    )
    similar = lambda k: near(F.col("n"), k["n"]) & forms_similar(F.col("form"), k["form"], config)
    undecided = undecided.select("job_id", "rank", "text", length(F.col("text")).alias("n"), form(F.col("text"), config).alias("form"))
    beyond = F.col("rank") > F.col("upto")
    met = join_bounded(undecided, settled, ["job_id"], written=True)
    now_kept = settled.select(F.explode("kept.rank").alias("rank"))
    if not groups:
        rest = met.where(beyond & ~F.exists("kept", similar)).select("job_id", "rank", "text")
        return now_kept, cut(rest, "undecided"), []
    first = F.get(F.filter("kept", lambda k: (k["rank"] < F.col("rank")) & similar(k)), 0)["rank"]
    met = cut(met.select("job_id", "rank", "text", beyond.alias("beyond"), first.alias("kept_rank")), "met")
    dropped = met.where("kept_rank IS NOT NULL").select("rank", "kept_rank")
    return now_kept, cut(met.where("beyond AND kept_rank IS NULL").select("job_id", "rank", "text"), "undecided"), [dropped]


def _lookup(config: SimilarityConfig) -> Lookup | None:
    """How candidates are found under the enabled rules; None if folds must do without."""
    if config.by_distance_only():
        return _gram_lookup(Reach(config))
    rules = config.active_comparisons()
    return LOOKUPS[rules[0].type](rules[0]) if len(rules) == 1 and rules[0].type in LOOKUPS else None


def _gram_lookup(reach: Reach) -> Lookup:
    """Edit distance: texts share one of their first grams, and lengths tell at a fraction of a comparison's cost."""
    slope = F.lit(1.0 - reach.threshold)
    known: list[tuple[Reach, np.ndarray]] = []

    def cap(longer: Column) -> Column:
        return F.greatest(F.lit(reach.distance), F.least(longer, F.floor(slope * longer).cast("int") + 1))

    def near(a: Column, b: Column) -> Column:
        return F.abs(a - b) <= cap(F.greatest(a, b))

    def of_role(nodes: DataFrame, wanted: int) -> DataFrame:
        if not known:
            closer = _closer(nodes, reach)
            known.append((closer, _gram_uses(nodes, closer)))
        bounds, uses = known[0]
        held = ["job_id", "rank", "length", "band"]
        kinds = dict(nodes.dtypes)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for owner, grams, roles, marks in _flat_keys(batch.column("text").to_pylist(), bounds, None, uses, wanted):
                    columns = [batch.column(name).take(pa.array(owner)) for name in held]
                    yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, (grams.view(np.int64), marks, roles))], [*held, "gram", "place", "role"])

        schema = ", ".join(f"{name} {kinds[name]}" for name in held) + ", gram bigint, place bigint, role int"
        return nodes.select(*held, "text").mapInArrow(rows, schema)

    def fits(n: Column, p: Column, m: Column, q: Column) -> Column:
        # An edit replaces at most two pairs of neighbours by two others.
        return F.bit_count(p.bitwiseXOR(q)) <= 4 * cap(F.greatest(n, m))

    return Lookup(F.char_length, near, reach.bands, lambda nodes: of_role(nodes, 0), fits, of_role)


def _closer(nodes: DataFrame, reach: Reach) -> Reach:
    """The bounds among the lengths that occur, if there are many texts."""
    counts = nodes.groupBy("length").agg(F.count("*").alias("n")).toPandas()
    texts = int(counts["n"].sum())
    return reach.among(sorted(counts["length"].tolist()), texts) if texts > MANY_TEXTS else reach


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of some ``CHARACTERS``, each with the place of its first text."""
    first = held = 0
    for at, text in enumerate(texts):
        if held and held + len(text) > CHARACTERS:
            yield first, texts[first:at]
            first, held = at, 0
        held += len(text)
    yield first, texts[first:]


def _grams_of(texts: list[str], reach: Reach) -> Iterator[tuple[int, np.ndarray, dict[int, np.ndarray], np.ndarray]]:
    """For each length of texts: it, the places of its texts, their grams by every gram length that a partner may have, and sketches.

    Grams are tables of a row for each text and a column for each start. A gram is packed as its length (3 bits) and
    hash (60 bits). Length 0 is one gram that stands for all texts. A sketch has a bit set for each pair of neighbours, of 64.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)

    @cache
    def of(q: int) -> np.ndarray:
        grams = np.zeros(max(len(codes) - q + 1, 0), dtype=np.uint64)
        for i in range(q):
            grams = (grams ^ codes[i : i + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(29)
        return (np.uint64(q % 8) << np.uint64(60)) | (grams >> np.uint64(4))

    order = np.argsort(sizes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(texts) else []:
        n = int(sizes[places[0]])
        begin = begins[places][:, None]
        table = lambda q: of(q)[begin + np.arange(n - q + 1)]  # noqa: E731, B023
        grams = {q: table(q) if q else np.zeros((len(places), 1), dtype=np.uint64) for q in reach.grams(n) if n and q <= n}
        bits = np.uint64(1) << (table(2) & np.uint64(63)) if n > 1 else np.zeros((len(places), 1), dtype=np.uint64)
        yield n, places, grams, np.bitwise_or.reduce(bits, axis=1).view(np.int64)


def _apart(cost: np.ndarray, q: int, many: int) -> np.ndarray:
    """For each row of costs, starts of ``many`` grams of length ``q`` that do not overlap, by least cost; of very long texts, out of chunks."""
    rows, starts = cost.shape
    n = starts + q - 1
    if n > LONG_TEXT:
        chunks = np.arange(0, starts, q)
        return chunks[np.argsort(cost[:, chunks], axis=1, kind="stable")[:, :many]]
    # best[j][:, i]: least cost of j grams that end at or before i.
    best = [np.zeros((rows, n + 1))]
    for _ in range(many):
        ending = np.full((rows, n + 1), np.inf)
        ending[:, q:] = best[-1][:, : n - q + 1] + cost
        best.append(np.minimum.accumulate(ending, axis=1))
    found, end = [], np.full(rows, n)
    for j in range(many, 0, -1):
        least = best[j][np.arange(rows), end]
        end = (best[j] > least[:, None]).sum(axis=1) - q
        found.append(end)
    return np.stack(found, axis=1)


def _flat_keys(
    texts: list[str], reach: Reach, common: np.ndarray | None, uses: np.ndarray, wanted: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The few grams each text is found by (role 1) and all grams it looks for (role 2): its place, the gram, role and sketch.

    An edit changes at most one of several grams that do not overlap, so of k+1 such grams
    of a text one at least is a gram of every text within k edits. A text shows the
    rarest: ``common`` (sorted) with ``uses`` are the frequent ones; without it uses are told by slots.
    """

    def cost(grams: np.ndarray) -> np.ndarray:
        if common is None:
            return uses[(grams & np.uint64(SLOTS - 1)).astype(np.int64)]
        if not len(common):
            return np.zeros(grams.shape)
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        return np.where(common[at] == grams, uses[at], 0).astype(float)

    for first, some in _pieces(texts):
        for n, places, grams, marks in _grams_of(some, reach):
            sides = []
            if n and wanted != 2:
                q = reach.gram(n)
                shown = grams[q]
                if q:
                    shown = np.take_along_axis(shown, _apart(cost(shown), q, reach.spread(n) + 1), axis=1)
                sides.append((1, shown))
            if n and wanted != 1:
                sides.append((2, np.concatenate(list(grams.values()), axis=1)))
            for role, keys in sides:
                keys = np.sort(keys, axis=1)
                new = np.ones(keys.shape, dtype=bool)
                new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                row = np.nonzero(new)[0]
                yield first + places[row], keys[new], np.full(len(row), role, dtype=np.int32), marks[row]


def _keys_of(texts: Iterable[str], reach: Reach, common: np.ndarray | None, uses: np.ndarray) -> list[tuple]:
    """Sketch of each text, the few grams it is found by and all grams it looks for."""
    texts = list(texts)
    none = np.zeros(0, dtype=np.int64)
    out = [[0, none, none] for _ in texts]
    for owner, grams, roles, marks in _flat_keys(texts, reach, common, uses):
        order = np.argsort(owner, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
            own = out[owner[some[0]]]
            own[0] = int(marks[some[0]])
            own[int(roles[0])] = grams[some].view(np.int64)
    return [tuple(own) for own in out]


def _grams(text: str, reach: Reach) -> list[tuple[int, np.ndarray]]:
    """``(q, grams)`` of one text."""
    return [(q, table[0]) for _, _, found, _ in _grams_of([text], reach) for q, table in found.items()]


def _gram_keys(text: str, reach: Reach, common: np.ndarray, uses: np.ndarray) -> np.ndarray:
    """All keys of one text, in either role."""
    _, shown, asked = _keys_of([text], reach, common, uses)[0]
    return np.concatenate([shown, asked])


def _gram_uses(nodes: DataFrame, reach: Reach) -> np.ndarray:
    """How often grams fall on each slot: counted by the tasks, of which each hands on one number a slot."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for _, some in _pieces(batch.column("text").to_pylist()):
                for _, _, grams, _ in _grams_of(some, reach):
                    for table in grams.values():
                        uses += np.bincount((table & np.uint64(SLOTS - 1)).astype(np.int64).ravel(), minlength=SLOTS)
        slots = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(uses[slots])], ["slot", "uses"])

    counted = nodes.select("text").mapInArrow(rows, "slot int, uses bigint")
    return _slots_of(counted.groupBy("slot").agg(F.sum("uses").alias("uses")))


def _lengths(texts: DataFrame, lookup: Lookup) -> list[int]:
    """All lengths that occur."""
    found = texts.select(lookup.length(F.col("text")).alias("length")).distinct().toPandas()["length"]
    return sorted(int(n) for n in found.dropna())


def _signatures(nodes: DataFrame, lookup: Lookup, lengths: list[int] | None = None, role: int = 0) -> DataFrame:
    """``(job_id, gram, band, rank, length, place, role)``: where a text may meet a partner; jobs are told by a hash.

    Of lookups that know roles, the keys of ``role`` alone if it is given.
    """
    longest = (lengths if lengths is not None else _lengths(nodes, lookup))[-1:]
    nodes = nodes.withColumn("length", lookup.length(F.col("text")))
    starts = F.array(*[F.lit(n) for n in lookup.bands(*(longest or [0]))])
    # Everything about the text is settled per text, before its keys become rows.
    band = F.size(F.filter(starts, lambda n: n <= F.col("length"))).alias("band")
    nodes = nodes.select(F.xxhash64("job_id").alias("job_id"), "rank", "length", band, "text")
    if role and lookup.of_role:
        return lookup.of_role(nodes, role)
    keys = lookup.keys(nodes)
    return keys if "role" in keys.columns else keys.withColumn("role", F.lit(0))


def _shown(signatures: DataFrame) -> DataFrame:
    return signatures.where("role < 2")


def _asked(signatures: DataFrame) -> DataFrame:
    return signatures.where("role <> 1")


BUCKET = ["job_id", "gram", "band"]


def _bucket() -> Column:
    return F.xxhash64(*BUCKET).alias("bucket")


def _heads(index: DataFrame, shown: int) -> DataFrame:
    """The first ``shown`` members of each bucket, numbered; cut down before the shuffle and after it.

    A member of that number is the last one shown: whether others are hidden is not known.
    """
    nth = F.row_number().over(Window.partitionBy("bucket").orderBy("rank"))
    return index.withColumn("bucket", _bucket()).withColumn("nth", nth).where(F.col("nth") <= shown).drop("bucket")


def _tasks(index: DataFrame) -> int:
    """Tasks of a bucket round: a task holds the index members of its buckets, in up to three bands each."""
    return max(index.sparkSession.sparkContext.defaultParallelism, 3 * written_rows(index) // TASK_KEYS)


def _visible(
    heads: DataFrame, probes: DataFrame, texts: DataFrame, config: SimilarityConfig, lookup: Lookup, shown: int, lengths: list[int], tasks: int
) -> tuple[DataFrame, DataFrame]:
    """What each probe sees of earlier index members in ``heads``, the first ``shown`` ones of each bucket.

    Returns the similar pairs ``(rank, earlier)`` and, per probe, ``limit``: the
    smallest rank up to which some bucket has been shown only in part (no row if
    every bucket was shown whole as far as this probe is concerned).
    """
    starts = lookup.bands(lengths[-1]) if lengths else [0]
    bands = sorted({bisect_right(starts, n) for n in lengths})
    # Partners are at most one length band away. Each member is a row: compiled code tells who is in reach.
    around = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    members = heads.select(
        "job_id", "gram", around, F.col("rank").alias("earlier"), F.col("length").alias("m"), F.col("place").alias("q"), (F.col("nth") == shown).alias("full")
    ).where(F.col("band").isin(bands))
    members = members.select(_bucket(), "earlier", "m", "q", "full")
    # Buckets hold few members each, so a task keeps those of its buckets; the many keys that ask for them pass by unsorted.
    asking = probes.select(_bucket(), "rank", "length", "place").repartition(tasks, "bucket")
    in_reach = lookup.near(F.col("m"), F.col("length")) & lookup.fits(F.col("m"), F.col("q"), F.col("length"), F.col("place"))
    met = asking.join(members.hint("shuffle_hash"), "bucket").where((F.col("earlier") < F.col("rank")) & (in_reach | F.col("full")))
    seen = cut(met.select("rank", F.when(in_reach, F.col("earlier")).alias("earlier"), F.when(F.col("full"), F.col("earlier")).alias("limit")), "seen")
    limits = seen.where("limit IS NOT NULL").groupBy("rank").agg(F.min("limit").alias("limit"))
    pairs = cut(seen.where("earlier IS NOT NULL").select("rank", "earlier").distinct(), "pairs")
    texts = texts.select("job_id", "rank", "text")
    if fits_broadcast(pairs):
        # Only the few texts of a pair move.
        named = pairs.select("rank").unionByName(pairs.select(F.col("earlier").alias("rank"))).distinct()
        texts = cut(texts.join(F.broadcast(named), "rank", "left_semi"), "named")
    theirs = texts.select(F.col("rank").alias("earlier"), F.col("job_id").alias("other_job"), F.col("text").alias("other"))
    # Buckets are told by hashes: that both texts are of one job is seen here.
    alike = (F.col("job_id") == F.col("other_job")) & are_similar(F.col("text"), F.col("other"), config)
    edges = pairs.join(texts, "rank").join(theirs, "earlier").where(alike).select("rank", "earlier")
    return cut(edges, "edges"), limits


def _bucket_round(
    undecided: DataFrame, index: DataFrame, probes: DataFrame, config: SimilarityConfig, lookup: Lookup, shown: int, lengths: list[int], tasks: int
) -> tuple[DataFrame, DataFrame]:
    """Decide every text whose earlier similar texts are all visible.

    A text that no edge and no hidden member blocks is kept; all steps after the search are on the few others.
    """
    edges, limits = _visible(_heads(index, shown), probes, undecided, config, lookup, shown, lengths, tasks)
    waiting = cut(limits.where(F.col("limit") < F.col("rank")).select("rank"), "waiting")
    gone: list[DataFrame] = []
    while True:
        blocked = cut(edges.select("rank").unionByName(waiting).distinct(), "blocked")
        # What is similar to a kept text goes.
        now = join_bounded(edges, blocked.select(F.col("rank").alias("earlier")), ["earlier"], "left_anti")
        now = cut(now.select("rank").distinct(), "now")
        if now.isEmpty():
            break
        gone.append(now)
        edges = join_bounded(edges, now, ["rank"], "left_anti", written=True)
        edges = cut(join_bounded(edges, now.withColumnRenamed("rank", "earlier"), ["earlier"], "left_anti"), "edges")
        waiting = cut(join_bounded(waiting, now, ["rank"], "left_anti", written=True), "waiting")
    settled = blocked
    for part in gone:
        settled = settled.unionByName(part)
    kept = cut(join_bounded(undecided.select("rank"), settled, ["rank"], "left_anti"), "keep")
    return kept, cut(join_bounded(undecided, blocked, ["rank"], "left_semi", written=True), "undecided")


def _absorb(nodes: DataFrame, kept: DataFrame, seekers: DataFrame, config: SimilarityConfig) -> DataFrame:
    """``(rank, kept_rank)``: each of the ``seekers`` with its earliest similar kept text.

    Each round shows the next kept members of every bucket. A text has looked
    far enough once all its buckets were shown up to the best partner so far.
    """
    texts = spread(nodes.select("job_id", "rank", "text"))
    lookup = _lookup(config)
    lengths = _lengths(texts, lookup)
    signatures = cut(_signatures(texts, lookup, lengths, 1), "signatures")
    tasks = _tasks(signatures)
    index = _shown(signatures).join(kept, "rank", "left_semi")
    out = kept.select("rank", F.col("rank").alias("kept_rank")).where(F.lit(False))
    best = None
    while not seekers.isEmpty():
        heads = cut(_heads(index, BUCKET_HEAD_LIMIT), "heads")
        if lookup.of_role:
            probes = _asked(_signatures(texts.join(seekers, "rank", "left_semi"), lookup, lengths, 2))
        else:
            probes = _asked(signatures).join(seekers, "rank", "left_semi")
        edges, limits = _visible(heads, probes, texts, config, lookup, BUCKET_HEAD_LIMIT, lengths, tasks)
        pairs = edges.withColumnRenamed("earlier", "kept_rank")
        pairs = pairs if best is None else pairs.unionByName(best)
        best = cut(pairs.groupBy("rank").agg(F.min("kept_rank").alias("kept_rank")).join(limits, "rank", "left"), "best")
        far_enough = F.col("limit").isNull() | (F.col("kept_rank") <= F.col("limit"))
        settled = best.where(far_enough).select("rank", "kept_rank")
        best = best.where(~far_enough).select("rank", "kept_rank")
        out = out.unionByName(settled)
        seekers = cut(seekers.join(settled.select("rank"), "rank", "left_anti"), "seekers")
        shown = heads.where(F.col("nth") == BUCKET_HEAD_LIMIT).select(*BUCKET, F.col("rank").alias("last"))
        index = cut(index.join(shown, BUCKET).where(F.col("rank") > F.col("last")).drop("last"), "index")
    return out
