"""Words and their fingerprints over whole Arrow batches of texts, as numpy operations on UTF-8 bytes.

Every ASCII class of bytes means the same on bytes as on code points, since UTF-8 uses bytes from 0x80 only inside
other characters. Null texts count as empty. Work goes in slices of about SLICE bytes of whole texts; a longer text is a
slice of its own and takes about 60 times its length in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20

#: Bytes outside [\x20\x09-\x0D]: a word is what stands between ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _step(j: int) -> np.uint64:
    """j times _STEP, modulo 2 ** 64."""
    return np.uint64(j * int(_STEP) % (1 << 64))


class Slice(NamedTuple):
    """Some texts of a batch: rows first..last, their bytes (not lower-cased), and where each begins (one more at the end)."""

    first: int
    last: int
    raw: np.ndarray
    begins: np.ndarray


class Words(NamedTuple):
    """Byte offsets of words in a slice's data, and the index of each text's first word (one more at the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def slices(texts: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[Slice]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + size, side="right")) - 1)
        stop = min(stop, n)
        yield Slice(row, stop, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row])
        row = stop


def words(part: Slice, inside: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    data = LOWER[part.raw] if lower else part.raw
    mask = inside[data]
    n = len(data)
    before = np.zeros(n, dtype=bool)
    before[1:] = mask[:-1]
    begins = part.begins
    before[begins[:-1][begins[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = mask[1:]
    nonempty = begins[1:] > begins[:-1]
    after[begins[1:][nonempty] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, begins))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 256), _BASE, dtype=np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers


def fingerprints(found: Words) -> np.ndarray:
    """A 64-bit fingerprint of each word's bytes, the same in every slice and process."""
    if not len(found.starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = found.ends - found.starts
    total = int(lengths.sum())
    shift = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(shift, lengths)
    index = place + np.repeat(found.starts, lengths)
    values = (found.data[index].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    sums = np.add.reduceat(values, shift)
    return mix(sums + lengths.astype(np.uint64) * _STEP)


def shingles(prints: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of every k consecutive words of each text and how many a text has; fewer words make one shingle.

    Repeats are kept, in order of place. A text without words has none.
    """
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    n = len(prints)
    rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k):
        rolled += mix(prints[j : j + len(rolled)] + _step(j + 1)) if len(rolled) else rolled
    out = np.zeros(int(made.sum()), dtype=np.uint64)
    at = np.cumsum(made) - made
    full = counts >= k
    if full.any():
        lengths = made[full]
        shift = np.cumsum(lengths) - lengths
        inner = np.arange(int(lengths.sum())) - np.repeat(shift, lengths)
        out[inner + np.repeat(at[full], lengths)] = rolled[inner + np.repeat(first[:-1][full], lengths)]
    for size in range(1, k):
        some = np.flatnonzero(counts == size)
        if len(some):
            value = np.full(len(some), _step(size + 1_000_003), dtype=np.uint64)
            for j in range(size):
                value += mix(prints[first[some] + j] + _step(j + 1))
            out[at[some]] = mix(value)
    return mix(out), made


def prefixes(found: Words, letters: int) -> tuple[Words, np.ndarray]:
    """The first code points of each word that has at least so many, and which words those are."""
    heads = np.flatnonzero((found.data & 0xC0) != 0x80)
    at = np.searchsorted(heads, found.starts) + letters
    past = np.append(heads, len(found.data))[np.minimum(at, len(heads))]
    some = np.flatnonzero((at <= len(heads)) & (past <= found.ends))
    return Words(found.data, found.starts[some], past[some], found.first), some


class Lookup:
    """Numbers of known fingerprints; -1 for others."""

    BITS = 16

    def __init__(self, known: np.ndarray) -> None:
        order = np.argsort(known)
        self.known, self.number = known[order], order
        self.may = np.zeros(1 << self.BITS, dtype=bool)
        self.may[self._cell(known)] = True

    def _cell(self, prints: np.ndarray) -> np.ndarray:
        return (prints >> np.uint64(64 - self.BITS)).astype(np.intp)

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        out = np.full(len(prints), -1, dtype=np.int64)
        if len(self.known):
            some = np.flatnonzero(self.may[self._cell(prints)])
            at = np.minimum(np.searchsorted(self.known, prints[some]), len(self.known) - 1)
            right = self.known[at] == prints[some]
            out[some[right]] = self.number[at[right]]
        return out


def fingerprints_of(texts: list[str], inside: np.ndarray = NOT_SPACE) -> list[np.ndarray]:
    """The words' fingerprints of each of some texts, all on the driver: for word lists and test items."""
    out: list[np.ndarray] = []
    for part in slices(pa.array(texts, type=pa.string())):
        found = words(part, inside)
        prints = fingerprints(found)
        out += [prints[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    return out
