"""Exact Jaccard self-join of word-shingle sets by partitioned universes, and its connected groups.

If two sets of sizes a and b have Jaccard similarity of at least t, they differ in at most (1 - t) / (1 + t) * (a + b) elements.
Sizes are cut into bands; in a band that bound is at most H. The universe of shingles is hashed into m segments, and a set spends
units on segments: one unit asks for an equal segment, two units for a segment with at most one element more or less
(found by the keys that leave out one element). If a set spends more than H units in all, any set linked
with it must match in one of the segments. Every set indexes all its segments, and the one-deletion keys of the first D of
them, under the band of its size and under the lower band that its smaller partners may lie in.

There are more units than a set must spend, and it saves the costliest ones: first segments without elements, then,
once the keys are counted over the whole corpus, those with the most holders. So keys that very many unlike
sets share are not followed.

Sets that are equal share a fingerprint and count as one. A key's holders are first compared with the heaviest of them, the one whose keys have
most holders (of a group of near copies, that is the text they were made from); what links is merged into components. Sets
that a key still joins with another component are indexed again among themselves, every element a segment of its own: a set of
size n shares at least t * n elements with any set linked to it, so it asks with its n - ceil(t * n) + 1 rarest elements. Those are
mostly the elements that set a text apart, so thousands of loose relatives, which share most of their segments, do not all meet. Of two sets
the lighter one asks. All comparisons are exact, on sorted 64-bit fingerprints of shingles.

Defined cases: texts that are null, empty or without words have no shingles and link with nothing; fewer than k words make one
shingle; repeated rows are each kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regioflux.llm import textbytes
from regioflux.llm.arrow import text_column
from regioflux.llm.components import components
from regioflux.llm.storage import drop, release, written


class Rule(NamedTuple):
    """Shingles of k words; sets link if den * intersection >= num * union."""

    k: int
    num: int
    den: int


class Bands(NamedTuple):
    """By band: least and greatest size, units to spend, segments, segments with one-deletion keys."""

    low: np.ndarray
    high: np.ndarray
    spend: np.ndarray
    segments: np.ndarray
    deletions: np.ndarray

    @property
    def slack(self) -> np.ndarray:
        return self.segments + self.deletions - self.spend


#: Sets larger than this fall outside the bands; no text of Spark's string size reaches it.
LARGEST = 1 << 31


@lru_cache
def bands(num: int, den: int) -> Bands:
    rows, low = [], 1
    while low <= LARGEST:
        high = max(low, low * den * den // (num * num))
        spend = (den - num) * (high + high * den // num) // (den + num) + 1
        rows.append((low, high, spend, spend + max(1, spend // 8), max(1, spend // 24)))
        low = high + 1
    return Bands(*(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)))


_U = np.uint64
_SEED = 0x51ED270B7F4A7C15


def sets(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By slice of texts: the sorted distinct shingles of all texts one after the other, and how many each has."""
    for part in textbytes.slices(texts):
        found = textbytes.words(part)
        values, made = textbytes.shingles(textbytes.fingerprints(found), found.first, k)
        owner = np.repeat(np.arange(len(made)), made)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        yield values[new], np.bincount(owner[new], minlength=len(made))


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit words by group, modulo 2 ** 64; exact for groups of under 2 ** 21 members, and the same for any order."""
    low = np.bincount(group, (values & _U(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(group, (values >> _U(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << _U(32))


def set_prints(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(counts)), counts)
    return textbytes.mix(_sums(textbytes.mix(values ^ _U(_SEED)), owner, len(counts)) + textbytes.mix(counts.astype(np.uint64)))


#: Places of a row's parts in its tag: whether empty segments are still among its own, band, own band or a visit, exact or
#: one-deletion, units to save, segment.
_FULL, _BAND, _OWN, _KIND, _SLACK = 62, 50, 49, 48, 24


def _keys(values: np.ndarray, counts: np.ndarray, band: np.ndarray, own: bool, b: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and tags of sets in the given band each."""
    m, deletions, slack = b.segments[band], b.deletions[band], b.slack[band]
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    seed = textbytes.mix(band.astype(np.uint64) + _U(_SEED))
    hashed = textbytes.mix(values ^ seed[owner])
    segment = ((hashed >> _U(32)) * m.astype(np.uint64)[owner] >> _U(32)).astype(np.int64)
    base = np.cumsum(m) - m
    at = base[owner] + segment
    total = int(m.sum())
    sums = _sums(hashed, at, total)
    size = np.bincount(at, minlength=total)
    of = np.repeat(np.arange(n), m)
    number = np.arange(total) - base[of]
    salt = textbytes.mix(seed[of] + number.astype(np.uint64))
    empty = (size == 0) & (number >= deletions[of])
    empties = np.bincount(of[empty], minlength=n)
    saves = empties <= slack
    slack = np.where(saves, slack - empties, slack)
    kept = ~(empty & saves[of])
    cut = segment < deletions[owner]
    tag = ((~saves).astype(np.int64) << _FULL) | (band << _BAND) | (int(own) << _OWN) | (slack << _SLACK)
    keys = np.concatenate([textbytes.mix(sums[kept] + salt[kept]), textbytes.mix(sums[at[cut]] - hashed[cut] + salt[at[cut]])])
    owners = np.concatenate([of[kept], owner[cut]])
    tags = np.concatenate([tag[of[kept]] | number[kept], tag[owner[cut]] | (1 << _KIND) | segment[cut]])
    return keys, owners, tags


def _placed(counts: np.ndarray, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Sets and bands: each set's own, then the lower ones with sizes that can link with it. Where only equal sets link there is nothing to find."""
    b = bands(rule.num, rule.den)
    own = np.searchsorted(b.low, counts, side="right") - 1
    for back in range(len(b.low)):
        band = own - back
        some = (counts > 0) & (band >= 0)
        some[some] &= (b.spend[band[some]] > 1) & (counts[some] * rule.num <= b.high[band[some]] * rule.den)
        if back and not ((counts > 0) & (band >= 0) & (counts * rule.num <= b.high[np.maximum(band, 0)] * rule.den)).any():
            return
        if some.any():
            yield np.flatnonzero(some), band[some], back == 0


def digests(docs: DataFrame, k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, print) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = text_column(batch, key), 0
            for values, counts in sets(text_column(batch, text), k):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(counts)), pa.array(counts), pa.array(set_prints(values, counts).view(np.int64))],
                    names=[key, "n_shingles", "print"],
                )
                row += len(counts)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles long, print long")


def index(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """(key, print, tag) rows of all different sets; equal sets of one task are written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for values, counts in sets(text_column(batch, text), rule.k):
                prints = set_prints(values, counts)
                fresh = np.zeros(len(counts), dtype=bool)
                for i, p in enumerate(prints.tolist()):
                    if counts[i] and p not in seen:
                        seen.add(p)
                        fresh[i] = True
                ends = np.cumsum(counts)
                for some, band, own in _placed(np.where(fresh, counts, 0), rule):
                    pick = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in some.tolist()])
                    keys, owners, tags = _keys(values[pick], counts[some], band, own, bands(rule.num, rule.den))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(prints[some][owners].view(np.int64)), pa.array(tags)], names=["key", "print", "tag"])

    return docs.select(text).mapInArrow(run, "key long, print long, tag long")


def holders(rows: DataFrame, rule: Rule) -> DataFrame:
    """The index rows of keys that different sets hold, with the units (0 to 2) each set spends on the segment, and its weight:
    how many other holders all its keys have, which is largest for the set in the middle of a group of near copies."""
    key = Window.partitionBy("key")
    shared = (
        rows.withColumns({"_low": F.min("print").over(key), "_high": F.max("print").over(key)})
        .filter("_low <> _high")
        .select("key", "print", "tag")
        .distinct()
        .withColumn("cost", F.count("*").over(key) - 1)
    )
    part = lambda at, bits: F.shiftright("tag", at).bitwiseAND((1 << bits) - 1)
    shared = shared.select(
        "key", "print", "cost", part(_FULL, 1).alias("full"), part(_BAND, 12).alias("band"), part(_OWN, 1).alias("own"), part(_KIND, 1).alias("kind"),
        part(_SLACK, 24).alias("slack"), part(0, 24).alias("segment"),
    )
    shared = written(shared, "shared-keys")
    release(rows.sparkSession)
    cut = F.array(*(F.lit(int(x)) for x in bands(rule.num, rule.den).deletions))
    place = ["print", "band", "own", "segment"]
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("cost")).otherwise(0)).cast("double")
    costs = shared.groupBy(*place, "slack").agg(of_kind(0).alias("one"), of_kind(1).alias("two"))
    # The second unit of a segment can be saved without the first, but not the first without the second.
    mean = (F.col("one") + F.col("two")) / 2
    both = F.col("one") > F.col("two")
    unit = lambda n, cost: F.struct(F.lit(n).alias("unit"), cost.alias("cost"))
    units = F.when(
        F.col("segment") < F.get(cut, F.col("band").cast("int")),
        F.array(unit(1, F.when(both, mean).otherwise(F.col("one"))), unit(2, F.when(both, mean).otherwise(F.col("two")))),
    ).otherwise(F.array(unit(1, F.col("one"))))
    order = Window.partitionBy("print", "band", "own").orderBy(F.desc("x.cost"), F.desc("x.unit"), "segment")
    spent = (
        costs.select(*place, "slack", F.explode(units).alias("x"))
        .withColumn("rank", F.row_number().over(order))
        .groupBy(*place)
        .agg(F.sum(F.when((F.col("rank") <= F.col("slack")) & (F.col("x.cost") > 0), 0).otherwise(1)).alias("units"))
    )
    weight = shared.groupBy("print").agg(F.sum("cost").alias("weight"))
    held = written(shared.join(spent, place).join(weight, "print").select("key", "print", "full", "own", "kind", "units", "weight"), "key-holders")
    drop(shared)
    return held


def _asks(one: str, other: str) -> F.Column:
    """Whether the units that one holder of a key spends make it a candidate with the other."""
    kinds = F.col(f"{one}kind") + F.col(f"{other}kind")
    return ((F.col(f"{one}units") >= 1) & (kinds == 0)) | ((F.col(f"{one}units") == 2) & (kinds < 2))


def star_pairs(held: DataFrame) -> DataFrame:
    """Pairs of each key's heaviest asking holder with the others."""
    key = Window.partitionBy("key")
    asking = (F.col("units") >= 1) & (F.col("kind") == 0)
    heaviest = F.max(F.when(asking, F.struct("own", "weight", "print", "units", "kind"))).over(key)
    found = held.withColumn("c", heaviest).filter(F.col("c.print") != F.col("print"))
    found = found.select(F.col("print").alias("x"), "own", "kind", *(F.col(f"c.{n}").alias(f"c_{n}") for n in ("print", "own", "units", "kind")))
    found = found.filter((F.col("own") + F.col("c_own") > 0) & _asks("c_", ""))
    return found.select(F.least("x", "c_print").alias("a"), F.greatest("x", "c_print").alias("b")).distinct()


def _mixed(held: DataFrame, merged: DataFrame) -> DataFrame:
    """The holders, with their component, of keys whose holders lie in several components."""
    key = Window.partitionBy("key")
    named = held.join(merged.select(F.col("node").alias("print"), "component"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    ends = {"_low": F.min("component").over(key), "_high": F.max("component").over(key)}
    return named.withColumns(ends).filter("_low <> _high").drop(*ends)


def loose(named: DataFrame) -> DataFrame:
    """(print) of the sets that a key makes a candidate with a set of another component, in either part.

    The units of either set are enough to find a pair, so the set of less weight asks, whose keys fewer others hold. Only a set that
    kept empty segments among its own may have spent units on one that the other set has left out; then both ask.
    """
    columns = ("print", "full", "own", "kind", "units", "weight", "component")
    asking = named.filter("units = 2 or (units = 1 and kind = 0)").select("key", *(F.col(c).alias(f"p_{c}") for c in columns))
    lighter = F.struct("p_weight", "p_print") < F.struct("weight", "print")
    found = (
        (asking["key"] == named["key"])
        & (F.col("p_component") != F.col("component"))
        & (F.col("own") + F.col("p_own") > 0)
        & (lighter | (F.col("full") + F.col("p_full") > 0))
        & _asks("p_", "")
    )
    one = asking.join(named, found, "left_semi").select(F.col("p_print").alias("print"))
    other = named.join(asking, found, "left_semi").select("print")
    return one.union(other).distinct()


def elements(stored: DataFrame, rule: Rule) -> DataFrame:
    """Every element of the sets (print, shingles) that several hold, its place among its set's elements from the rarest on, and
    whether its set asks with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                cells = [c.as_buffer() for c in batch.column(1)[start : start + 256]]
                counts = np.array([len(c) // 8 for c in cells], dtype=np.int64)
                owner = np.repeat(np.arange(len(cells)), counts)
                values = pa.array(np.frombuffer(b"".join(cells), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([values, batch.column(0)[start : start + 256].take(pa.array(owner)), pa.array(counts[owner])], names=["key", "print", "n"])

    rows = stored.select("print", "shingles").mapInArrow(run, "key long, print long, n long")
    shared = rows.withColumn("cost", F.count("*").over(Window.partitionBy("key")) - 1).filter("cost > 0")
    own = Window.partitionBy("print")
    spend = F.col("n") - F.floor((F.col("n") * rule.num + rule.den - 1) / rule.den) + 1
    alone = F.col("n") - F.count("*").over(own)
    place = F.row_number().over(own.orderBy("cost", "key")) + alone
    shared = shared.withColumns({"weight": F.sum("cost").over(own), "place": place})
    return shared.select("key", "print", "n", "weight", "place", (F.col("place") <= spend).alias("asks"))


def other_pairs(named: DataFrame, done: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of sets of different components, among elements that several components share, where the lighter one asks with a shared element; not those done.

    If that is the first element they share, from the rarest on, they share no more than it and what either has left; a pair that links
    passes this bound there.
    """
    asking = named.filter("asks").select("key", *(F.col(c).alias(f"p_{c}") for c in ("print", "n", "weight", "place", "component")))
    most = F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place")) + 1
    both = asking.join(named, "key").filter(
        (F.col("p_component") != F.col("component"))
        & (F.struct("p_weight", "p_print") < F.struct("weight", "print"))
        & (F.least("n", "p_n") * rule.den >= F.greatest("n", "p_n") * rule.num)
        & (most * (rule.num + rule.den) >= (F.col("n") + F.col("p_n")) * rule.num)
    )
    pairs = both.select(F.least("print", "p_print").alias("a"), F.greatest("print", "p_print").alias("b")).distinct()
    return pairs.join(done, ["a", "b"], "left_anti")


def linked(pairs: DataFrame, stored: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of set prints whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (2, 3))
                if min(len(x), len(y)) * rule.den >= max(len(x), len(y)) * rule.num:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = both * rule.den >= (len(x) + len(y) - both) * rule.num
            yield batch.select([0, 1]).filter(pa.array(keep))

    with_a = pairs.join(stored.select(F.col("print").alias("a"), F.col("shingles").alias("of_a")), "a")
    with_b = with_a.join(stored.select(F.col("print").alias("b"), F.col("shingles").alias("of_b")), "b")
    return with_b.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def stored_sets(docs: DataFrame, known: DataFrame, prints: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(print, shingles) of the given sets, from the text of one document of each."""
    chosen = prints.join(known.groupBy("print").agg(F.min(key).alias(key)), "print").select(key, "print")
    texts = docs.select(key, text).join(chosen, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            wanted, row = batch.column(2).to_numpy(), 0
            for values, counts in sets(batch.column(1), k):
                own = set_prints(values, counts).view(np.int64)
                # A document id that several rows share brings other texts along.
                right = [i for i in range(len(counts)) if own[i] == wanted[row + i] and int(own[i]) not in seen]
                seen.update(int(own[i]) for i in right)
                ends = np.cumsum(counts)
                found = [values[ends[i] - counts[i] : ends[i]].tobytes() for i in right]
                yield pa.RecordBatch.from_arrays([pa.array(own[right]), pa.array(found, type=pa.binary())], names=["print", "shingles"])
                row += len(counts)

    return texts.select(key, text, "print").mapInArrow(run, "print long, shingles binary").dropDuplicates(["print"])


def groups(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row; component_id is the least key reachable by links."""
    known = written(digests(docs, rule.k, key, text), "set-prints")
    held = holders(index(docs, rule, text), rule)
    pairs = written(star_pairs(held), "first-pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("print")).union(loose(held.withColumn("component", F.col("print")))).distinct()
    stored = written(stored_sets(docs, known, needed, rule.k, key, text), "sets")
    release(docs.sparkSession)
    links = written(linked(pairs, stored, rule), "first-links")
    release(docs.sparkSession)
    merged = written(components(links), "first-groups")
    mixed = written(_mixed(held, merged), "mixed-keys")
    drop(held)
    release(docs.sparkSession)
    asked = written(loose(mixed), "loose-sets")
    drop(mixed)
    release(docs.sparkSession)
    shared = written(elements(stored.join(asked, "print", "left_semi"), rule), "elements")
    release(docs.sparkSession)
    mixed = written(_mixed(shared, merged), "mixed-elements")
    drop(shared)
    release(docs.sparkSession)
    pairs = written(other_pairs(mixed, pairs, rule), "other-pairs")
    drop(mixed)
    release(docs.sparkSession)
    more = written(linked(pairs, stored, rule), "other-links")
    drop(stored)
    again = components(merged.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    of_print = known.filter("n_shingles > 0").groupBy("print").agg(F.min(key).alias("_least"))
    of_print = of_print.join(again.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = of_print.groupBy("component").agg(F.min("_least").alias("component_id"))
    by_print = of_print.join(least, "component").select("print", "component_id")
    out = known.join(by_print, "print", "left")
    return out.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(key)).alias("component_id"))
