"""URL filtering: rules by longest match, and a list of domains held in a cascade of Bloom filters.

A cascade gives exact membership for a known universe of keys without a join. Level 0 is a Bloom filter of the listed keys;
level 1 holds the keys of the universe that level 0 passes although they aren't listed; level 2 the listed keys that level 1
passes; and so on, until a level makes no mistake. A key is looked up level by level until one doesn't hold it: listed if
the number of levels that held it is odd. The universe is every host suffix of the corpus, so each answer is exact.

Native DataFrame operations only. Filters are binary literals of a size fixed by the number of keys they hold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Rules as (host, path, verdict); the longest host that fits wins, then the longest path.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Listed names are a first word, a hyphen and a second one; each means <name>.example.<com, net, org> and every host under it.
LISTED_FIRST = (
    "adult", "ads", "bargain", "bet", "bingo", "bonus", "casino", "cheap", "click", "coupon", "crypto", "dating", "discount", "fake", "fast", "free",
    "gambling", "instant", "jackpot", "keyword", "loan", "lottery", "miracle", "payday", "pharma", "pirate", "poker", "prize", "spam", "warez",
)
LISTED_SECOND = (
    "ads", "bets", "boost", "cash", "clicks", "codes", "deals", "download", "farm", "games", "links", "loans", "market", "offers", "outlet", "pills",
    "pool", "push", "rank", "slots", "store", "stream", "track", "traffic", "tube", "win", "x", "zone",
)
LISTED_UNDER = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{a}-{b}.{end}" for a in LISTED_FIRST for b in LISTED_SECOND for end in LISTED_UNDER)
#: Hashes of a key in the levels above 0, which pass one other key in 16 or so; level 0 takes more where the universe is larger.
HASHES = 4
MAX_HASHES = 40
BITS_PER_HASH = 1.5
#: Bits of one shard of a filter at most. A level with more keys has its keys dealt to several shards by hash.
MAX_BITS = 1 << 23
MAX_LEVELS = 64
#: Shards of a cascade at most: they are literals of the plan, 1 MB each. Enough for some 50 million listed names.
MAX_SHARDS = 64


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url. The host lies between the first :// and the next /, ? or #, with A-Z lower-cased; the path
    follows up to ? or #. Both are empty for a null url and one without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def suffixes(host: Column) -> Column:
    """The host and every parent domain: a.b.c gives a.b.c, b.c and c. An empty host has none."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are compared by the length of host and path together,
    then of the host; equal ones by their place in the list."""
    rule = verdict = F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(domain + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


@dataclass(frozen=True)
class BloomFilter:
    #: Bits of each shard.
    bits: int
    shards: tuple[bytes, ...]
    hashes: int = HASHES

    def holds(self, key: Column, level: int) -> Column:
        found, words = F.lit(True), F.lit(self.shards[0])
        if len(self.shards) > 1:
            words = F.element_at(F.array(*map(F.lit, self.shards)), _shard(key, len(self.shards), level) + 1)
        for place in _places(key, self.bits, level, self.hashes):
            byte = F.conv(F.hex(F.substring(words, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            found = found & (F.call_function("shiftright", byte, (7 - F.pmod(place, F.lit(8))).cast("int")).bitwiseAND(1) == 1)
        return found


def _places(key: Column, bits: int, level: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def hashes_for(listed: int, universe: int) -> int:
    """Hashes of level 0 that let about as many of the universe pass wrongly as there are listed keys, HASHES at least. So
    the levels above hold no more keys than the list does, however large the universe is."""
    return min(MAX_HASHES, max(HASHES, math.ceil(math.log2(max(1, universe) / max(1, listed)))))


def _shard(key: Column, shards: int, level: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(-1)), F.lit(shards)).cast("int")


def _filter_of(keys: DataFrame, level: int, hashes: int = HASHES) -> BloomFilter | None:
    """The filter of the keys in column `key`, about half of its bits set, or None where there are none. At most MAX_BITS / 64 rows
    reach the driver at once, those of one shard."""
    n = keys.distinct().count()
    if not n:
        return None
    size = math.ceil(n * hashes * BITS_PER_HASH)
    shards = -(-size // MAX_BITS)
    if shards > MAX_SHARDS:
        raise ValueError(f"{n} keys need {shards} MB of filters, and a plan should carry {MAX_SHARDS} at most; split the list by domain")
    bits = max(64, -(-size // (64 * shards)) * 64)
    if shards > 1:
        keys = written(keys, "url-level")
    place = F.explode(F.array(*_places(F.col("key"), bits, level, hashes)))
    made = []
    for shard in range(shards):
        some = keys.filter(_shard(F.col("key"), shards, level) == shard) if shards > 1 else keys
        marks = some.select(place.alias("place")).groupBy(F.expr("place div 64").cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(63 - place % 64 as int))")).alias("value")
        )
        words = bytearray(bits // 8)
        for word, value in marks.collect():
            words[8 * word : 8 * word + 8] = value.to_bytes(8, "big", signed=True)
        made.append(bytes(words))
    return BloomFilter(bits, tuple(made), hashes)


@dataclass(frozen=True)
class Cascade:
    """Levels of Bloom filters; exact for the universe it was built over."""

    levels: tuple[BloomFilter, ...]

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """Both have one column, `key`; nulls are ignored. `universe` should be a written table: each level reads it."""
        listed, universe = listed.dropna().distinct(), universe.dropna()
        levels: list[BloomFilter] = []
        hashes = hashes_for(listed.count(), universe.count())
        while len(levels) < MAX_LEVELS:
            if len(levels) % 2:
                wrong = universe.join(F.broadcast(listed), "key", "left_anti") if _small(listed) else universe.join(listed, "key", "left_anti")
            else:
                wrong = listed
            for i, level in enumerate(levels):
                wrong = wrong.filter(level.holds(F.col("key"), i))
            made = _filter_of(wrong, len(levels), HASHES if levels else hashes)
            if made is None:
                return cls(tuple(levels))
            levels.append(made)
            if sum(len(x.shards) for x in levels) > MAX_SHARDS:
                raise ValueError(f"the levels need more than {MAX_SHARDS} MB of filters; split the list by domain")
        raise RuntimeError("the cascade doesn't end")

    def holds(self, key: Column) -> Column:
        """Whether the key is listed: it is if the first level without it comes after an odd number of levels."""
        found = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            found = F.when(self.levels[i].holds(key, i), found).otherwise(F.lit(i % 2 == 1))
        return found


def _small(listed: DataFrame, rows: int = 100_000) -> bool:
    return listed.limit(rows + 1).count() <= rows


def host_universe(hosts: DataFrame) -> DataFrame:
    """Every distinct host suffix of column `host`, as a written table with the column `key`."""
    return written(hosts.select("host").distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct(), "url-keys")


def judge(pages: DataFrame, listed: Sequence[str] | DataFrame = LISTED, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    The verdict is the longest fitting rule's; where none fits, `block` for a host that is listed or lies under a listed
    domain, else `allow`. Null or malformed urls have an empty host and path, no rule, and are allowed. Repeated rows are
    judged each; an empty table gives an empty table; other columns are ignored. `listed`: names, or a table of one column for
    long lists. Raises ValueError for a list whose filters pass MAX_SHARDS.
    """
    host, path = url_parts(F.col(url))
    parts = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    if isinstance(listed, DataFrame):
        keys = written(listed.toDF("key"), "url-list")
    else:
        names = F.split(F.lit("\n".join(listed)), "\n") if listed else F.array().cast("array<string>")
        keys = written(spark.range(1).select(F.explode(names).alias("key")), "url-list")
    cascade = Cascade.build(keys, host_universe(parts))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    is_listed = F.exists(suffixes(F.col("host")), cascade.holds)
    return parts.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
