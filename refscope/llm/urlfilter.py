"""URL filters: rules on hosts and paths, and exact lists held as a cascade of Bloom filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refscope.llm.common import ascii_lower, written

#: Bits for each key of a level, and hash functions; about one key in 120 passes by chance.
BITS_PER_KEY, HASHES = 10, 4
#: One filter has at most so many bits; a longer list is split into that many more filters by hash.
FILTER_BITS = 1 << 22
#: The filters are values of the query plan, not a joined table, up to this many bits in all (8 MB).
PLAN_BITS = 1 << 26
#: Where rows meet their shard's filters in a join, every shard is that many keys, so that few shards are many tasks.
SPREAD = 32
_MOST_LEVELS = 64


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: what follows the first ``://`` up to ``/ ? #``, A-Z lower-cased, and then up to ``? #``.

    Both are empty for a null and for an url without ``://``.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, i), F.lit("")) for i in (1, 2))
    return ascii_lower(host), path


@dataclass(frozen=True)
class Rule:
    """Allow or block a host with all its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; nulls if none does.

    Length is that of host and path together; of equally long rules the one with
    the longer host counts, then the blocking one.
    """
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.verdict == "block")):
        fits = rule.fits(host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _places(key: Column, level: int, bits: Column) -> list[Column]:
    """Bit places of a key in a filter of ``bits`` bits: two hashes, stepped."""
    one, two = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), bits) for i in range(2))
    return [F.pmod(one + F.lit(i) * two, bits) for i in range(HASHES)]


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("int")


@dataclass
class Cascade:
    """Filters of all levels; ``shards`` rows of (shard, levels: array of bit words) written as a table."""

    filters: DataFrame
    sizes: list[int]
    shards: int
    in_plan: bool

    def contains(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """``rows`` with a boolean column: exact for every key of the universe, false for null.

        The first level that does not have the key decides: an even number of
        levels passed means "not listed". No key is joined with the list. Filters of at
        most ``plan_bits`` bits, over all shards, are one value in the plan; else each row meets its
        shard's filters, one row of bounded size.
        """
        if self.in_plan:
            return rows.withColumn(name, F.coalesce(self._test(key, self._own(key)), F.lit(False)))
        columns = rows.columns
        packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key.alias("key"))
        found = self._beside(packed).select("row", F.coalesce(self._test(F.col("key"), F.col("levels")), F.lit(False)).alias("in"))
        return found.select("row.*", F.col("in").alias(name))

    def passing(self, keys: DataFrame, level: int) -> DataFrame:
        """Rows ``(key, in)`` whose key the filters, which are those of one ``level``, let pass."""
        if self.in_plan:
            return keys.where(self._hit(F.col("key"), level, F.get(self._own(F.col("key")), 0), self.sizes[0]))
        rows = self._beside(keys)
        return rows.where(self._hit(F.col("key"), level, F.get("levels", 0), self.sizes[0])).select("key", "in")

    def _own(self, key: Column) -> Column:
        """The levels of a key's shard, out of one value: at most ``plan_bits`` bits in all."""
        if self.shards == 1:
            return self.filters.select("levels").scalar()
        every = F.transform(F.array_sort(F.collect_list(F.struct("shard", "levels"))), lambda x: x["levels"])
        return F.get(self.filters.select(every).scalar(), _shard(key, self.shards))

    def _beside(self, rows: DataFrame) -> DataFrame:
        """``rows(key, ...)`` with the levels of their shard."""
        salt = F.pmod(F.xxhash64(F.col("key"), F.lit(-2)), F.lit(SPREAD)).cast("int")
        rows = rows.withColumn("shard", F.coalesce(_shard(F.col("key"), self.shards), F.lit(0))).withColumn("salt", salt)
        side = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        return rows.join(side.hint("shuffle_merge"), ["shard", "salt"]).drop("shard", "salt")

    @staticmethod
    def _hit(key: Column, level: int, words: Column, bits: int) -> Column:
        hit = F.lit(True)
        for place in _places(key, level, F.lit(bits)):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            hit = hit & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        return hit

    def _test(self, key: Column, levels: Column) -> Column:
        verdict = F.lit(len(self.sizes) % 2 == 1)
        for level in reversed(range(len(self.sizes))):
            hit = self._hit(key, level, F.get(levels, F.lit(level)), self.sizes[level])
            verdict = F.when(hit, verdict).otherwise(F.lit(level % 2 == 1))
        return F.when(key.isNotNull(), verdict)


def build_cascade(
    universe: DataFrame,
    key: str,
    listed: str,
    bits_per_key: int = BITS_PER_KEY,
    filter_bits: int = FILTER_BITS,
    plan_bits: int = PLAN_BITS,
) -> Cascade:
    """A cascade that tells the listed keys of ``universe(key, listed)`` from all its other keys.

    Level 1 encodes the listed keys; level 2 the other keys that level 1 lets
    pass; level 3 the listed keys that level 2 lets pass; and so on until none
    pass wrongly, so every key of the universe gets its exact answer. A key listed in any row is
    listed; null keys are ignored; an empty list makes a cascade that has
    nothing, a list of all keys one level. Filters so small that the levels do not
    come to an end raise an error.
    """
    any_listed = F.max(F.coalesce(F.col(listed), F.lit(False))).alias("in")
    keys = universe.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(any_listed)
    keys = written(keys, "keys")
    n = keys.where("in").count()
    shards = max(1, -(-n * bits_per_key // filter_bits))
    passing, sizes, tables = keys, [], []
    for level in range(_MOST_LEVELS):
        own = passing.where(F.col("in") == F.lit(level % 2 == 0))
        count = own.count()
        if not count:
            break
        # All shards of a level have one size; hashing keeps their loads within a few per cent.
        bits = max(64, -(-count * bits_per_key // (shards * 64)) * 64)
        sizes.append(bits)
        places = F.array(*_places(F.col("key"), level, F.lit(bits)))
        set_bits = own.select(_shard(F.col("key"), shards).alias("shard"), F.explode(places).alias("place"))
        words = set_bits.groupBy("shard", F.shiftright("place", 6).alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(pmod(place, 64) as int))")).alias("bits")
        )
        spark = universe.sparkSession
        all_words = spark.range(shards * (bits // 64)).select(
            F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("word")
        )
        # An array of bounded length for each shard: at most ``filter_bits`` and what its level adds by chance.
        dense = all_words.join(words, ["shard", "word"], "left").groupBy("shard").agg(
            F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("w")
        )
        tables.append(written(dense.select("shard", F.transform("w", lambda x: x["bits"]).alias(f"l{level}")), "filter"))
        now = Cascade(tables[-1].select("shard", F.array(f"l{level}").alias("levels")), [bits], shards, shards * bits <= plan_bits)
        # The other kind goes on where this level lets it pass; all of this kind are in it.
        other = passing.where(F.col("in") != F.lit(level % 2 == 0))
        passing = written(now.passing(other, level).unionByName(own), "passing")
    else:
        raise RuntimeError(f"{_MOST_LEVELS} levels of filters do not tell all keys apart: give more bits a key")
    filters = universe.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    for table in tables:
        filters = filters.join(table, "shard")
    levels = [F.col(f"l{i}") for i in range(len(tables))]
    packed = F.array(*levels) if levels else F.array().cast("array<array<bigint>>")
    filters = written(filters.select("shard", packed.alias("levels")), "cascade")
    return Cascade(filters, sizes, shards, shards * sum(sizes) <= plan_bits)


def judged(
    pages: DataFrame,
    rules: list[Rule],
    cascade_key: str,
    cascade: Cascade,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` for every row: the longest rule's verdict, else the list's.

    ``cascade_key`` is an SQL expression over ``host`` and ``path``; a listed key
    blocks. A null url and one without ``://`` have empty host and path and are
    judged like any other; a null id stays null; repeated rows are judged alike; an
    empty table gives none.
    """
    host, path = split_url(F.col(f"`{url_column}`"))
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = cascade.contains(rows, F.expr(cascade_key), "listed")
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict")
    )
