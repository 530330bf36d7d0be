"""Benchmark decontamination: BM25 over test items with block-max bounds, every training passage a query, matches verified.

The items are the indexed side. They are dealt into shards of about SHARD_BYTES of text, each with an inverted index of its own under
statistics of all items: postings as impacts, sorted by term and item, and for each term the largest impact in each block of items that it
occurs in. Nothing grows with vocabulary times items. The driver and a task hold one shard at a time. Documents are cut into passages that
overlap by half and are longer than twice the longest item, so that every occurrence of an item lies within a passage. Every passage is a query of
block-max WAND, over blocks of items in the order of their thresholds; some hundred passages move from pivot to pivot in lockstep, as rows of one
array of cursors. Only postings of blocks whose largest impacts reach their least threshold are scored. All items that reach their threshold are
retrieved. An item's threshold is its score against itself less the most that a passage may
lose and still be verified, so no match is lost.

A match is verified by SHARE: of the item's shingles of five words (fewer words: the whole), and of the different words of its question (first two thirds)
and of its answer (the rest), at least that share is in the passage. Words are runs of letters and digits, lower-cased in ASCII.

Defined cases: null and empty texts match nothing; items that are null or without words are ignored; repeated items
and documents match each; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm import textbytes
from regioflux.llm.arrow import add_columns, by_bytes, text_column
from regioflux.llm.storage import written

K1, B = 1.2, 0.75
BLOCK = 16
SHINGLE = 5
SHARE = 0.8
ANSWER = 1 / 3
#: Passages that are searched in lockstep.
TOGETHER = 1024
#: Bytes of items' text in a shard, about, and items whose parts a worker remembers.
SHARD_BYTES = 8 << 20
REMEMBERED = 4096


class Statistics(NamedTuple):
    """Of all items: how many have words, words in all, words of the longest, and how many hold each word of a shard."""

    n: int
    words: int
    longest: int
    holders: dict[int, int]


def _ranges(first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers from each first to its stop, one range after the other."""
    size = stop - first
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


class Items:
    """The inverted index of a shard of the test items, or of all of them where no statistics are given."""

    def __init__(self, ids: list, texts: list[str | None], statistics: Statistics | None = None) -> None:
        prints = textbytes.fingerprints_of([t or "" for t in texts], textbytes.ALNUM)
        some = [i for i, p in enumerate(prints) if len(p)]
        self.ids = [ids[i] for i in some]
        if not some:
            return
        vocabulary, flat = np.unique(np.concatenate([prints[i] for i in some]), return_inverse=True)
        self.lookup = textbytes.Lookup(vocabulary)
        length = np.array([len(prints[i]) for i in some], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(length)])
        self.flat = flat.astype(np.int32)
        pair, counts = np.unique(np.repeat(np.arange(len(some)), length) * len(vocabulary) + flat, return_counts=True)
        item, term = np.divmod(pair, len(vocabulary))
        if statistics is None:
            statistics = Statistics(len(some), int(length.sum()), int(length.max()), {})
            holders = np.bincount(term, minlength=len(vocabulary))
        else:
            holders = np.array([statistics.holders[x] for x in vocabulary.view(np.int64).tolist()])
        idf = np.log(1 + (statistics.n - holders + 0.5) / (holders + 0.5))
        norm = K1 * (1 - B + B * length / (statistics.words / statistics.n))
        impact = idf[term] * counts * (K1 + 1) / (counts + norm[item])
        self.longest = statistics.longest
        self.remembered: dict[int, tuple[set, np.ndarray, np.ndarray]] = {}
        ends = np.cumsum(np.bincount(item, minlength=len(some)))
        threshold = np.zeros(len(some))
        for i, own in enumerate(np.split(impact, ends[:-1])):
            question, answer = self._halves(self._tokens(i))
            lost = sum(len(x) - self.needed(len(x)) for x in (question, answer))
            threshold[i] = np.sort(own)[: len(own) - lost].sum() * (1 - 1e-9)
        # Blocks of items with like thresholds keep the blocks' bounds tight.
        self.order = np.argsort(threshold, kind="stable")
        self.threshold = threshold[self.order]
        self.block_least = np.minimum.reduceat(self.threshold, np.arange(0, len(some), BLOCK))
        rank = np.empty(len(some), dtype=np.int64)
        rank[self.order] = np.arange(len(some))
        by = np.lexsort((rank[item], term))
        # Postings: item places and impacts, by term and place; their blocks: number, first posting, largest impact; each term's first block.
        self.place, self.impact = rank[item][by].astype(np.int32), impact[by]
        key = term[by] * (len(self.block_least) + 1) + self.place // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.block = self.place[first] // BLOCK
        self.block_key = key[first]
        self.block_first = np.append(first, len(key))
        self.block_most = np.maximum.reduceat(self.impact, first)
        self.term_first = np.searchsorted(term[by][first], np.arange(len(vocabulary) + 1))
        self.most = np.maximum.reduceat(self.block_most, self.term_first[:-1])

    def _tokens(self, item: int) -> np.ndarray:
        return self.flat[self.begin[item] : self.begin[item + 1]]

    @staticmethod
    def _halves(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different words of an item's question and answer."""
        cut = len(t) - max(1, int(len(t) * ANSWER)) if len(t) > 1 else 1
        return np.unique(t[:cut]), np.unique(t[cut:])

    @staticmethod
    def needed(n: int) -> int:
        """The least whole number that is at least SHARE of n."""
        return -int(-(n * SHARE - 1e-9) // 1)

    @staticmethod
    def _shingles(tokens: np.ndarray, k: int) -> set[tuple[int, ...]]:
        rows = tokens.tolist()
        return {tuple(rows[i : i + k]) for i in range(len(rows) - k + 1)} if k else set()

    def blocks_of(self, passage: np.ndarray, term: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, place in the block lists) of every list entry in the blocks that may hold a match, for pairs of a passage and a term.

        Block-max WAND for all passages in lockstep: a row of cursors for each passage, one cursor in the block list of each of its terms. A
        step sorts the cursors by block and finds the pivot, the first block that the largest impacts of all lists up to it can lift to its least
        threshold; thresholds rise with the blocks. Cursors before the pivot jump to it without a look at what lies between. The block's own largest
        impacts then tell whether it is passed on, and the cursors leave it. Passages without a pivot are finished and drop out.
        """
        counts = np.bincount(passage, minlength=passages)
        first = np.cumsum(counts) - counts
        slot = np.arange(len(term)) - first[passage]
        none = len(self.block)
        block = np.append(self.block, len(self.block_least))
        block_most = np.append(self.block_most, 0.0)
        least = np.append(self.block_least, np.inf)
        shape = (passages, int(counts.max(initial=0)))
        cursor, stop, of = np.full(shape, none), np.full(shape, none), np.zeros(shape, dtype=np.int64)
        most = np.zeros(shape)
        cursor[passage, slot], stop[passage, slot], of[passage, slot] = self.term_first[term], self.term_first[term + 1], term
        most[passage, slot] = self.most[term]
        number = np.arange(passages)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        alive = (most.sum(axis=1) >= least[0]) & (counts > 0)
        while True:
            if not alive.all():
                number, cursor, stop, of, most = (x[alive] for x in (number, cursor, stop, of, most))
            if not len(number):
                break
            at = block[cursor]
            order = np.argsort(at, axis=1)
            ordered = np.take_along_axis(at, order, axis=1)
            reaches = np.cumsum(np.take_along_axis(most, order, axis=1), axis=1) >= least[ordered]
            pivot = np.where(reaches.any(axis=1), np.take_along_axis(ordered, reaches.argmax(axis=1)[:, None], axis=1)[:, 0], len(self.block_least))
            alive = pivot < len(self.block_least)
            behind = at < pivot[:, None]
            cursor[behind] = np.searchsorted(self.block_key, (of * (len(self.block_least) + 1) + pivot[:, None])[behind])
            cursor = np.where(cursor < stop, cursor, none)
            here = (block[cursor] == pivot[:, None]) & alive[:, None]
            enough = np.where(here, block_most[cursor], 0.0).sum(axis=1) >= least[pivot]
            row, column = np.nonzero(here & enough[:, None])
            out.append((number[row], cursor[row, column]))
            cursor = cursor + here
            cursor = np.where(cursor < stop, cursor, none)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2

    def candidates(self, passage: np.ndarray, term: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of every item that reaches its threshold."""
        of, entry = self.blocks_of(passage, term, passages)
        postings = _ranges(self.block_first[entry], self.block_first[entry + 1])
        key = np.repeat(of, self.block_first[entry + 1] - self.block_first[entry]) * len(self.threshold) + self.place[postings]
        pairs, number = np.unique(key, return_inverse=True)
        scores = np.bincount(number, self.impact[postings], len(pairs))
        of, place = np.divmod(pairs, len(self.threshold))
        enough = scores >= self.threshold[place]
        return of[enough], self.order[place[enough]], scores[enough]

    def _verified(self, item: int, terms: np.ndarray, tokens: np.ndarray) -> float:
        k = min(SHINGLE, int(self.begin[item + 1] - self.begin[item]))
        if item not in self.remembered:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            own = self._tokens(item)
            self.remembered[item] = (self._shingles(own, k), *self._halves(own))
        own, *parts = self.remembered[item]
        for part in parts:
            if np.isin(part, terms, assume_unique=True).sum() < self.needed(len(part)):
                return 0.0
        both = len(own & self._shingles(tokens, k))
        return both / len(own) if both >= self.needed(len(own)) else 0.0

    def matches(self, part: textbytes.Slice) -> Iterator[tuple[int, int, float, float, int]]:
        """(row, item, score, shared shingles, first word of the passage), one for each row and item: its best passage."""
        if not self.ids:
            return
        found = textbytes.words(part, inside=textbytes.ALNUM)
        ids = self.lookup(textbytes.fingerprints(found))
        step = max(self.longest, 32)
        counts = np.diff(found.first)
        passages = np.maximum(1, -(-counts // step) - 1) * (counts > 0)
        row = np.repeat(np.arange(len(counts)), passages)
        low = found.first[:-1][row] + step * (np.arange(len(row)) - np.repeat(np.cumsum(passages) - passages, passages))
        high = np.minimum(low + 2 * step, found.first[1:][row])
        best: dict[tuple[int, int], tuple[float, float, int]] = {}
        for a in range(0, len(row), TOGETHER):
            tokens = ids[_ranges(low[a : a + TOGETHER], high[a : a + TOGETHER])]
            key = np.repeat(np.arange(len(low[a : a + TOGETHER])), (high - low)[a : a + TOGETHER]) * len(self.most) + tokens
            passage, term = np.divmod(np.unique(key[tokens >= 0]), len(self.most))
            edges = np.searchsorted(passage, np.arange(len(low[a : a + TOGETHER]) + 1))
            for i, item, score in zip(*(x.tolist() for x in self.candidates(passage, term, len(edges) - 1)), strict=True):
                share = self._verified(item, term[edges[i] : edges[i + 1]], ids[low[a + i] : high[a + i]])
                if share:
                    at = (int(row[a + i]), item)
                    value = (share, score, -int(low[a + i] - found.first[row[a + i]]))
                    best[at] = max(best.get(at, value), value)
        for (r, item), (share, score, first) in sorted(best.items()):
            yield part.first + r, item, score, share, -first


def indexes(items: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The indexes of all shards, one after the other."""
    rows = items.select(F.col(item).alias("item"), F.col(text).alias("text")).filter("text <> ''")
    shards = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    if shards <= 1:
        yield Items(*_columns(rows))
        return

    def make(batch: pa.RecordBatch) -> list:
        prints = textbytes.fingerprints_of(text_column(batch, "text").to_pylist(), textbytes.ALNUM)
        return [pa.array([p.view(np.int64) for p in prints], type=pa.list_(pa.int64()))]

    dealt = written(add_columns(rows.withColumn("shard", (F.rand(1) * shards).cast("int")), "words array<long>", make), "leak-items")
    n, words, longest = dealt.filter("size(words) > 0").agg(F.count("*"), F.sum(F.size("words")), F.max(F.size("words"))).first()
    if not n:
        yield Items([], [])
        return
    word = F.explode(F.array_distinct("words")).alias("word")
    holders = written(dealt.select(word).groupBy("word").agg(F.count("*").alias("n")), "leak-holders")
    for shard in range(shards):
        part = dealt.filter(F.col("shard") == shard)
        own = holders.join(part.select(word).distinct(), "word").collect()  # the words of one shard
        yield Items(*_columns(part), Statistics(n, words, longest, {r["word"]: r["n"] for r in own}))


def _columns(rows: DataFrame) -> tuple[list, list]:
    collected = rows.select("item", "text").collect()  # the items of one shard
    return [r[0] for r in collected], [r[1] for r in collected]


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, score, shared, first_word): every document and test item of which it holds a passage."""
    kind = pa.int64() if items.schema[item].dataType.simpleString() == "bigint" else None
    names = [key, item, "score", "shared", "first_word"]

    def run(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [m for part in textbytes.slices(text_column(batch, text)) for m in index.value.matches(part)]
            if found:
                r, i, score, share, first = zip(*found, strict=True)
                ids = text_column(batch, key).take(pa.array(r, type=pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([index.value.ids[x] for x in i], type=kind), pa.array(score), pa.array(share), pa.array(first, type=pa.int64())], names=names
                )

    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    ddl = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, score double, shared double, first_word long"
    out = None
    for shard in indexes(items, item, item_text):
        index = docs.sparkSession.sparkContext.broadcast(shard)
        found = by_bytes(docs.select(key, text)).mapInArrow(lambda batches, index=index: run(batches, index), ddl)
        out = found if out is None else out.union(found)
    return out


def flagged(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", name: str = "leaked") -> DataFrame:
    """All columns of the documents and whether each holds a passage of a test item."""

    def add(rows: DataFrame, index, more: bool) -> DataFrame:
        def make(batch: pa.RecordBatch) -> list:
            out = text_column(batch, name).to_numpy(zero_copy_only=False).copy() if more else np.zeros(batch.num_rows, dtype=bool)
            for part in textbytes.slices(text_column(batch, text)):
                for match in index.value.matches(part):
                    out[match[0]] = True
            return [out]

        return add_columns(written(rows, "leak-flags") if more else rows, f"{name} boolean", make)

    out = docs
    for i, shard in enumerate(indexes(items, item, item_text)):
        out = add(out, docs.sparkSession.sparkContext.broadcast(shard), i > 0)
    return out
