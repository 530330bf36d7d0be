"""URL filters: exact membership of URL keys in rule lists by a cascade of Bloom filters, without joins on the URLs' path.

A key is a host suffix (at a dot) with as many labels as some rule has, and the beginning of a path, of a length that some rule has. The universe of keys is that of the
whole table and the list. Level 1 encodes the listed keys; the universe's other keys that it lets through are encoded by level 2, the
listed ones that this lets through by level 3, and so on until none is left. A key of the universe is listed if the first level
that rejects it is an even one (none: if the number of levels is odd), so the answer is exact for every URL of the table.

Levels are arrays of 64-bit words in a small table, which scalar subqueries hand to the tasks. Their size follows the list: level 1 takes about
1.44 * log2(universe / list) bits a key, the further ones about 4 in all. Lists of more than PART keys are cut by the keys' hash
into several cascades, each probed in a branch of its own, so that no task holds more than one of them (PART keys
with a universe 2 ** 30 times as large take 6 MB).

Defined cases: a url that is null or has no `://` has an empty host and path and fits no rule; repeated rows are judged
each; among fitting rules the longest wins (then the longer host, then allow); repeated rules count once; a rule with an empty host
fits nothing; without rules, or in an empty table, every verdict is the default.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regioflux.llm.storage import written

#: Keys of a list that one cascade encodes.
PART = 1_000_000
#: Hash functions of the levels after the first, which let half of other keys through.
LATER_HASHES = 1

#: The letters that are lower-cased in a host.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: str) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def key(host_part: Column, path_part: Column) -> Column:
    """Host and path of a key, with the host's length in front, so that both can be told apart."""
    return F.concat(F.length(host_part).cast("string"), F.lit(":"), host_part, path_part)


def labels(host_part: str) -> Column:
    """How many labels a host has."""
    return F.length(host_part) - F.length(F.replace(host_part, F.lit("."), F.lit(""))) + 1


def keys(counts: list[int], lengths: list[int]) -> Column:
    """All keys of columns host and path, for hosts of the given numbers of labels and paths of the given lengths."""
    some = F.array(*(F.when(labels("host") >= n, F.substring_index("host", ".", -n)) for n in counts))
    suffixes = F.filter(some, lambda x: x.isNotNull())
    begins = F.filter(F.array(*(F.when(F.length("path") >= m, F.substring("path", 1, m)) for m in lengths)), lambda x: x.isNotNull())
    made = F.flatten(F.transform(suffixes, lambda h: F.transform(begins, lambda p: key(h, p))))
    return F.when(F.col("host") != "", made).otherwise(F.array().cast("array<string>"))


class Level(NamedTuple):
    """One Bloom filter: its number (which seeds the hashes), bits, hash functions, and the table with its words."""

    number: int
    bits: int
    hashes: int
    words: DataFrame


def _places(value: Column, number: int, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a value: one hash for each function. The level comes first, so keys that collide in one level part in the next."""
    return [F.pmod(F.xxhash64(F.lit(number), F.lit(j), value), F.lit(bits)) for j in range(hashes)]


def _level(values: DataFrame, number: int, bits: int, hashes: int) -> Level:
    """Encodes the column `key`. Words are folded map-side; the last aggregate puts bits / 64 of them in order."""
    n_words = -(-bits // 64)
    spark = values.sparkSession
    places = values.select(F.explode(F.array(*_places(F.col("key"), number, bits, hashes))).alias("place"))
    set_bits = places.select(F.floor(F.col("place") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int")).alias("bits"))
    all_words = set_bits.union(spark.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    folded = all_words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = folded.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return Level(number, bits, hashes, written(words, "bloom-level"))


def _passes(value: Column, level: Level, words: Column) -> Column:
    found = [F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in _places(value, level.number, level.bits, level.hashes)]
    return reduce(lambda a, b: a & b, found)


class Cascade(NamedTuple):
    """Levels 1, 2, ... of one part of the list."""

    levels: list[Level]

    def columns(self) -> dict[str, Column]:
        """The words of each level, to be added to a table before `member`."""
        return {f"_words{x.number}": x.words.scalar() for x in self.levels}

    def member(self, value: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(_passes(value, level, F.col(f"_words{level.number}")), answer).otherwise(F.lit(level.number % 2 == 0))
        return answer


def cascade(universe: DataFrame) -> Cascade:
    """From (key, listed) with every key once. The sets that each level encodes shrink by half from level to level."""
    n, listed = (int(x or 0) for x in universe.agg(F.count("*"), F.sum(F.col("listed").cast("int"))).first())
    levels: list[Level] = []
    if not listed:
        return Cascade(levels)
    rate = min(0.5, listed / (math.sqrt(2) * max(n - listed, 1)))
    hashes = max(1, round(-math.log2(rate)))
    inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
    left = listed
    while left:
        number = len(levels) + 1
        k = hashes if number == 1 else LATER_HASHES
        levels.append(_level(inside, number, max(64, math.ceil(left * k / math.log(2))), k))
        last = levels[-1]
        passed = outside.withColumn("_words", last.words.scalar()).filter(_passes(F.col("key"), last, F.col("_words"))).select("key")
        inside, outside = written(passed, "bloom-passed"), inside
        left = inside.count()
    return Cascade(levels)


def _split(df: DataFrame, part: int, parts: int) -> DataFrame:
    return df if parts == 1 else df.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", id_column: str = "page_id") -> DataFrame:
    """(id_column, host, path, rule, verdict) of every page. rules: (host, path, verdict), verdict being allow or block."""
    rules = rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull()).select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").distinct()
    counts = sorted(r[0] for r in rules.select(labels("host")).distinct().collect())  # numbers of labels in the list
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # path lengths of the list
    parsed = pages.select(F.col(id_column), host(url).alias("host"), path(url).alias("path"))
    if not lengths:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    parsed = parsed.withColumn("keys", keys(counts, lengths))
    listed = rules.select(key(F.col("host"), F.col("path")).alias("key"), "verdict")
    every = parsed.select(F.explode("keys").alias("key")).select("key", F.lit(False).alias("allow"), F.lit(False).alias("block"))
    tagged = every.union(listed.select("key", F.col("verdict") == "allow", F.col("verdict") == "block"))
    universe = written(tagged.groupBy("key").agg(F.max("allow").alias("allow"), F.max("block").alias("block")), "url-keys")
    out = parsed
    for verdict in ("allow", "block"):
        parts = max(1, -(-universe.filter(verdict).count() // PART))
        found = [cascade(_split(universe.select("key", F.col(verdict).alias("listed")), i, parts)) for i in range(parts)]
        if parts == 1:
            names = found[0].columns()
            out = out.withColumns(names).withColumn(verdict, F.filter("keys", found[0].member)).drop(*names)
        else:
            out = _in_parts(out, verdict, found, id_column)
    best = F.array_max(F.concat(_ranked("allow"), _ranked("block")))
    return out.withColumn("best", best).select(
        id_column, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.when(F.col("best.allow") == 1, "allow").when(F.col("best.allow") == 0, "block"), F.lit(default)).alias("verdict")
    )


def _ranked(verdict: str) -> Column:
    """The keys found in a verdict's list, as structs that order as the rules do."""

    def ranked(found: Column) -> Column:
        size = F.substring_index(found, ":", 1)
        rule = F.substring(found, F.length(size) + 2, F.length(found))
        return F.struct(F.length(rule).alias("length"), size.cast("int").alias("host"), F.lit(int(verdict == "allow")).alias("allow"), rule.alias("rule"))

    return F.transform(verdict, ranked)


def _in_parts(out: DataFrame, verdict: str, found: list[Cascade], id_column: str) -> DataFrame:
    """The listed keys of every row for a list in several cascades: one after the other, each pass written."""
    out = out.withColumn(verdict, F.array().cast("array<string>"))
    for i, part in enumerate(found):
        number = F.lit(i)
        own = F.filter("keys", lambda k: F.pmod(F.xxhash64(k), F.lit(len(found))) == number)  # noqa: B023
        names = part.columns()
        out = out.withColumns(names).withColumn(verdict, F.concat(verdict, F.filter(own, part.member))).drop(*names)
        out = written(out, "url-pass")
    return out
