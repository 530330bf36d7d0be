"""Alignment of two tokenizers over the bytes of the same texts, by lockstep merging of their token ends.

A text is read as a space and the text, by tokenizer A (byte-level BPE) and by tokenizer B (pieces, which adds the space itself). Offsets where tokens
of both end cut the tokens into groups, and link the two tokens that end there. `aligned` gives groups and links of every document;
`add_counts` counts over the whole corpus how often each pair of ids is linked, and sums that up for every document.

The ends of A's and B's tokens of a slice of texts are two rising sequences. Lanes of at most LANE bytes of one document each hold one pointer
into either. One step compares the ends under all lanes' pointers, emits links and cuts where they are equal, and advances the pointer at
the smaller end (both where equal). Lanes that have no token left on one side are compacted away. Lanes keep the number of steps
small for very long documents too; a link depends on one end only, so cutting a document into lanes loses none.

For the counts, documents go in blocks of about BLOCK bytes: a task passes on each different pair of a block once, with its number of links, and
each document's links as numbers of pairs of its block. Counts are summed up over blocks, joined back to the blocks' pairs, and
looked up per block. A pair that is in a third of all links is thus one row for each block.

Defined cases: a text that is null, empty, or that the tokens of A or B do not spell out with its space (such as one with U+2581, which B's pieces
read as a space) has no tokens: all its numbers are 0 and its digest is empty. Repeated rows and ids are documents of their own, and all
count. An empty table gives no rows. Of other columns only the key is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm.arrow import by_bytes
from regioflux.llm.byte_level import byte_level, in_slices
from regioflux.llm.storage import written

LANE = 512
#: Characters that are aligned together.
SLICE = 1 << 18
#: Bytes of text whose pairs are numbered together.
BLOCK = 1 << 23


class Spelling:
    """The bytes of every id of a vocabulary."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        size = max(tokens, default=-1) + 1
        listed = [tokens.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(t) for t in listed], dtype=np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(listed), dtype=np.uint8)

    def written_out(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        shift = self.first[ids] - (np.cumsum(lengths) - lengths)
        return self.data[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)]


class Pieces:
    """A worker's tokenizer B: pieces in UTF-8 with U+2581 as a space, and byte pieces as their byte."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            tokens[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        self.spelling = Spelling(tokens)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.array(ids, dtype=np.uint32) for ids in self.model.encode(texts, num_threads=1)]
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


class _Pair(NamedTuple):
    a: object
    a_spelling: Spelling
    b: Pieces


_pairs: dict[tuple[str, str], _Pair] = {}


def _pair(a_path: str, b_path: str) -> _Pair:
    if (a_path, b_path) not in _pairs:
        a = byte_level(a_path, added=False)
        _pairs.clear()
        _pairs[a_path, b_path] = _Pair(a, Spelling(a.tokens), Pieces(b_path))
    return _pairs[a_path, b_path]


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, bounds: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Places in a_ends and b_ends (both rising) of all ends that are in both; bounds are where documents begin and, last, end."""
    sizes = np.diff(bounds)
    pieces = -(-sizes // lane)
    number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.repeat(bounds[:-1], pieces) + number * lane
    high = np.minimum(low + lane, np.repeat(bounds[1:], pieces))
    state = np.stack([np.searchsorted(ends, edge, side="right") for edge in (low, high) for ends in (a_ends, b_ends)])
    found: list[np.ndarray] = []
    state = state[:, (state[0] < state[2]) & (state[1] < state[3])]
    while state.shape[1]:
        a, b = a_ends[state[0]], b_ends[state[1]]
        meet = a == b
        found.append(state[:2, meet])
        state[0] += a <= b
        state[1] += b <= a
        alive = (state[0] < state[2]) & (state[1] < state[3])
        if not alive.all():
            state = state[:, alive]
    links = np.hstack(found) if found else np.zeros((2, 0), np.int64)
    return tuple(links[:, np.argsort(links[0], kind="stable")])


class Aligned(NamedTuple):
    """The documents of a slice in a row: which texts have tokens, ids and numbers of tokens, places of linked tokens, and links of each."""

    valid: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    links: tuple[np.ndarray, np.ndarray]
    n_links: np.ndarray


def align(texts: list[str], a_path: str, b_path: str) -> Aligned:
    """Alignment of texts that are not empty."""
    pair = _pair(a_path, b_path)
    spaced = [" " + t for t in texts]
    raw = [t.encode() for t in spaced]
    a, n_a = pair.a.encode_all(spaced)
    b, n_b = pair.b.encode_all(texts)
    valid = np.ones(len(texts), dtype=bool)
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    for ids, counts, spelling in ((a, n_a, pair.a_spelling), (b, n_b, pair.b.spelling)):
        each = np.repeat(np.arange(len(texts)), counts)
        valid &= np.bincount(each, spelling.lengths[ids], len(texts)) == sizes
    a, b = a[np.repeat(valid, n_a)], b[np.repeat(valid, n_b)]
    text_of = np.repeat(np.arange(len(texts))[valid], sizes[valid])
    data = np.frombuffer(b"".join(r for r, v in zip(raw, valid, strict=True) if v), dtype=np.uint8)
    wrong = (pair.a_spelling.written_out(a) != data) | (pair.b.spelling.written_out(b) != data)
    if wrong.any():
        before = valid.copy()
        valid[text_of[wrong]] = False
        a, b = a[np.repeat(valid[before], n_a[before])], b[np.repeat(valid[before], n_b[before])]
    bounds = np.append(0, np.cumsum(sizes[valid]))
    a_ends, b_ends = np.cumsum(pair.a_spelling.lengths[a]), np.cumsum(pair.b.spelling.lengths[b])
    links = lockstep(a_ends, b_ends, bounds)
    per_text = np.diff(np.searchsorted(a_ends[links[0]], bounds, side="right"))
    return Aligned(valid, a, b, np.where(valid, n_a, 0), np.where(valid, n_b, 0), links, per_text)


_digits = np.zeros((0, 0), np.uint8), np.zeros(0, np.int64)


def _decimal(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digits of ids in rows of one width, from the left, and how many there are."""
    global _digits
    if len(ids) and len(_digits[1]) <= int(ids.max()):
        listed = [str(i) for i in range(int(ids.max()) + 1)]
        width = len(listed[-1])
        _digits = np.frombuffer("".join(s.ljust(width) for s in listed).encode(), np.uint8).reshape(-1, width), np.array([len(s) for s in listed])
    return _digits[0][ids], _digits[1][ids]


def groups(found: Aligned) -> list[bytes]:
    """The groups of each text that has tokens, as `a1,a2|b1;a3|b2,b3`."""
    a_last, b_last = found.links
    a_group = np.searchsorted(a_last, np.arange(len(found.a)))
    b_group = np.searchsorted(b_last, np.arange(len(found.b)))
    b_before = np.append(0, b_last + 1)
    total = len(found.a) + len(found.b)
    ids, marks = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    a_at = np.arange(len(found.a)) + b_before[a_group]
    b_at = np.arange(len(found.b)) + a_last[b_group] + 1
    ids[a_at], ids[b_at] = found.a, found.b
    marks[a_at[a_last]], marks[b_at[b_last]] = ord("|"), ord(";")
    digits, lengths = _decimal(ids)
    room = np.empty((total, digits.shape[1] + 1), np.uint8)
    room[:, :-1] = digits
    room[np.arange(total), lengths] = marks
    out = room[np.arange(room.shape[1]) <= lengths[:, None]]
    stops = np.append(0, np.cumsum(lengths + 1))[np.append(0, np.cumsum((found.n_a + found.n_b)[found.valid]))]
    return [out[p : q - 1].tobytes() for p, q in zip(stops[:-1], stops[1:], strict=True)]


class _Block:
    """The documents of a block and the pairs of their links, until the block is passed on."""

    def __init__(self, number: int, key: pa.DataType, with_groups: bool) -> None:
        self.number, self.key, self.with_groups = number, key, with_groups
        self.rows: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: list, texts: list[str], a_path: str, b_path: str) -> None:
        some = [i for i, t in enumerate(texts) if t]
        found = align([texts[i] for i in some], a_path, b_path) if some else None
        spelled = iter(groups(found)) if some else iter(())
        links = iter(found.n_links.tolist()) if some else iter(())
        at = {j: i for i, j in enumerate(some)}
        for j, key in enumerate(keys):
            i = at.get(j)
            if i is None or not found.valid[i]:
                self.rows.append((key, 0, 0, 0, "", "" if self.with_groups else None))
            else:
                text = next(spelled)
                digest = hashlib.sha256(text).hexdigest()
                self.rows.append((key, int(found.n_a[i]), int(found.n_b[i]), next(links), digest, text.decode() if self.with_groups else None))
        if some:
            a, b = found.a[found.links[0]].astype(np.uint64), found.b[found.links[1]].astype(np.uint64)
            self.codes.append(a << np.uint64(32) | b)
        # A document without text takes room too.
        self.held += sum(map(len, texts)) + 64 * len(texts)

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate([np.zeros(0, np.uint64), *self.codes])
        pairs, number, counts = np.unique(codes, return_inverse=True, return_counts=True)
        number = number.astype("<u2" if len(pairs) < 1 << 16 else "<u4")
        keys, n_a, n_b, n_links, digests, texts = (list(c) for c in zip(*self.rows, strict=True))
        ends = np.cumsum([0, *n_links])
        links = [number[p:q].tobytes() for p, q in zip(ends[:-1], ends[1:], strict=True)]
        yield self._batch(len(keys), _key=pa.array(keys, self.key), n_a=n_a, n_b=n_b, n_links=n_links, groups_sha256=digests, groups=texts, links=links)
        if len(pairs):
            ids = {"a": (pairs >> np.uint64(32)).astype(np.int32), "b": (pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)}
            yield self._batch(len(pairs), **ids, pair=np.arange(len(pairs), dtype=np.int32), n=counts)

    def _batch(self, size: int, **columns: object) -> pa.RecordBatch:
        kinds = {"block": pa.int64(), "_key": self.key} | {n: pa.int64() for n in ("n_a", "n_b", "n_links")}
        kinds |= {"groups_sha256": pa.string(), "groups": pa.string(), "links": pa.binary()}
        kinds |= {"a": pa.int32(), "b": pa.int32(), "pair": pa.int32(), "n": pa.int64()}
        columns["block"] = np.full(size, self.number)
        made = [pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays(made, names=list(kinds))


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", with_groups: bool = False) -> DataFrame:
    """Two kinds of rows by blocks, those of documents (links as numbers of pairs) and those of pairs (a is not null): what add_counts takes."""
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        block = None
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            first = 0
            for some in in_slices(texts, SLICE):
                block = block or _Block(made, keys.type, with_groups)
                block.add(keys[first : first + len(some)].to_pylist(), some, a_path, b_path)
                first += len(some)
                if block.held >= BLOCK:
                    yield from block.passed_on()
                    block, made = None, made + 1
        if block:
            yield from block.passed_on()

    kind = rows.schema["_key"].dataType.simpleString()
    made = "n_a long, n_b long, n_links long, groups_sha256 string, groups string, links binary, a int, b int, pair int, n long"
    return by_bytes(rows).mapInArrow(run, f"block long, _key {kind}, {made}")


def add_counts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every document of aligned's table, which is read three times."""
    pairs = found.filter("a IS NOT NULL").select("block", "a", "b", "pair", "n")
    documents = found.filter("a IS NULL").select(F.col("block").alias("of_block"), "_key", "n_a", "n_b", "n_links", "groups_sha256", "groups", "links")
    counts = written(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    scored = counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))
    answers = pairs.join(scored, ["a", "b"]).select("block", "pair", "count", "best")
    kind = found.schema["_key"].dataType.simpleString()

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        count, best = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        at = np.asarray(right["pair"])
        count[at], best[at] = np.asarray(right["count"]), np.asarray(right["best"]).astype(np.int64)
        number = np.frombuffer(b"".join(left["links"].to_pylist()), "<u2" if size < 1 << 16 else "<u4")
        ends = np.append(0, np.cumsum(np.asarray(left["n_links"])))
        sums = [np.diff(np.append(0, np.cumsum(values[number]))[ends]) for values in (best, count)]
        names = ["_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]
        links = left["n_links"]
        return pa.table([left["_key"], left["n_a"], left["n_b"], links, links, *map(pa.array, sums), left["groups_sha256"], left["groups"]], names=names)

    made = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    joined = documents.groupBy("of_block").cogroup(answers.groupBy("block")).applyInArrow(total, f"_key {kind}, {made}")
    return joined.withColumnRenamed("_key", key)
