"""Secret scans: base patterns, and credential-like strings found by the likelihood of inferred formats.

One pass over whole texts finds the base spans and all candidates (runs of CANDIDATE characters of at least LEAST with
a letter and a digit outside the base spans). All distinct credentials inside the base spans are the labelled values: for each kind, the states
of the prefix tree of all of them are merged by a Hoeffding test to a probabilistic automaton, and a walk of all values through it gives its shares. All
distinct candidates give the background. Every candidate of every document is then scored: the best automaton's
log-likelihood per character less the background's. It becomes a span of kind `format` if the score reaches the
LOWEST quantile of all labelled values and is above 0.

The driver merges prefix trees of at most STATES places. Of a larger kind it holds the accepted states only: each round of merges is a job in which Spark walks all
values through them, counts the nodes below the states that are not accepted yet, and tests those nodes against the ones that the accepted states lead to.
Both ways take the same steps on the same counts, so the automata are equal.

Defined cases: null and empty texts give no spans; documents with the same id are scanned each; without labelled values
of any kind no span is added; an empty table gives no rows. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm import grammar, textbytes
from regioflux.llm.arrow import add_columns, by_bytes, fields, text_column
from regioflux.llm.byte_level import in_slices
from regioflux.llm.storage import drop, written

#: Places of all values of a kind up to which the driver merges their prefix tree; Spark merges larger ones.
STATES = 1 << 16
#: Numbers that a task counts visits of nodes with before it sends them on.
VISITS = 1 << 18
LEAST = 16
LOWEST = 0.02

#: The base patterns (letters of the first in either case) and the lengths a match needs.
ASSIGN = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "format")


def _bytes(*ranges: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for r in ranges:
        table[ord(r[0]) : ord(r[-1]) + 1] = True
    return table


_HEX = _bytes("0-9", "a-f")
_ACCESS = _bytes("A-Z", "0-9")
_CANDIDATE = _bytes("A-Z", "a-z", "0-9", "+", "/", "_", "=", "-")
_DIGIT, _LETTER = _bytes("0-9"), _bytes("A-Z", "a-z")

SPAN = "struct<kind:int,start:long,stop:long>"
SCANNED = f"base array<{SPAN}>, secrets array<struct<kind:int,value:string>>, candidates array<struct<start:long,value:string>>"


def _runs(part: textbytes.Slice, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    found = textbytes.words(part, inside=table, lower=False)
    long = found.ends - found.starts >= least
    return found.starts[long], found.ends[long]


def _scan(part: textbytes.Slice) -> list[tuple[list, list, list]]:
    n = part.last - part.first
    whole = part.raw.tobytes()
    spans: list[list] = [[] for _ in range(n)]
    values: list[list] = [[] for _ in range(n)]
    candidates: list[list] = [[] for _ in range(n)]
    begins = part.begins.tolist()
    for d in range(n):
        for m in ASSIGN.finditer(whole, begins[d], begins[d + 1]):
            if m.end(1) - m.start(1) >= ASSIGN_LEAST:
                spans[d].append((0, m.start(), m.end()))
                values[d].append((0, m[1].decode()))
    for kind, table, least in ((1, _ACCESS, ACCESS_LEAST), (2, _HEX, HEX_LEAST)):
        for start, end in zip(*(x.tolist() for x in _runs(part, table, least)), strict=True):
            if kind == 1:
                start = whole.find(b"AKIA", start, end)
                if start < 0 or end - start < least:
                    continue
            d = int(np.searchsorted(part.begins, start, side="right")) - 1
            spans[d].append((kind, start, end))
            values[d].append((kind, whole[start:end].decode()))
    digits = np.concatenate([[0], np.cumsum(_DIGIT[part.raw])])
    letters = np.concatenate([[0], np.cumsum(_LETTER[part.raw])])
    starts, ends = _runs(part, _CANDIDATE, LEAST)
    mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    for start, end in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
        d = int(np.searchsorted(part.begins, start, side="right")) - 1
        if all(end <= s or start >= e for _, s, e in spans[d]):
            candidates[d].append((start, end))
    out = []
    for d in range(n):
        if not spans[d] and not candidates[d]:
            out.append(([], [], []))
            continue
        char = np.concatenate([[0], np.cumsum((part.raw[begins[d] : begins[d + 1]] & 0xC0) != 0x80)])
        at = lambda x, b=begins[d], c=char: int(c[x - b])
        base = sorted(({"kind": k, "start": at(s), "stop": at(e)} for k, s, e in spans[d]), key=lambda x: (x["start"], x["kind"]))
        out.append((base, [{"kind": k, "value": v} for k, v in values[d]], [{"start": at(s), "value": whole[s:e].decode()} for s, e in candidates[d]]))
    return out


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))
_VALUE_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("value", pa.string())]))
_CANDIDATE_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("value", pa.string())]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of the documents with the base spans, their credentials and the candidates."""

    def make(batch: pa.RecordBatch) -> list:
        found = [row for part in textbytes.slices(text_column(batch, text)) for row in _scan(part)]
        kinds = (_SPAN_TYPE, _VALUE_TYPE, _CANDIDATE_TYPE)
        return [pa.array([row[i] for row in found], type=t) for i, t in enumerate(kinds)]

    return add_columns(docs, SCANNED, make)


class Formats(NamedTuple):
    """An automaton for each kind that has values, the background, and the lowest score that makes a span."""

    automata: list[grammar.Automaton]
    background: grammar.Automaton | None
    least: float

    def score(self, value: str) -> float:
        if not self.automata or self.background is None:
            return -math.inf
        return max(a.score(value) for a in self.automata) - self.background.score(value)


def formats(automata: dict[int, grammar.Automaton], symbols: list[tuple[str, int]]) -> Formats:
    """The automata with a background of one state: what a string of such characters is like without a format. symbols: how often each occurs, "" for the end."""
    if not automata:
        return Formats([], None, math.inf)
    total = sum(n for _, n in symbols)
    shares = {s: math.log(n / total) for s, n in symbols}
    background = grammar.Automaton([{s: (0, log) for s, log in shares.items() if s}], [shares[""]], math.log(1 / total))
    return Formats([a for _, a in sorted(automata.items())], background, 0.0)


_SHAPES = np.arange(256, dtype=np.uint64)
for _of, _class in grammar.CLASSES.items():
    _SHAPES[ord(_of)] = ord(_class)


def _placed(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit number of each symbol at its place; a prefix is the sum of its symbols' numbers."""
    return textbytes.mix(symbols + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(256))


def _child(prefix: int, symbol: str, length: int) -> int:
    with np.errstate(over="ignore"):
        step = _placed(np.array([ord(symbol)], dtype=np.uint64), np.array([length]))
        return int((np.array([prefix], dtype=np.int64).view(np.uint64) + step).view(np.int64)[0])


def _prefixes(kinds: np.ndarray, values: list[str]) -> dict[str, np.ndarray]:
    """kind, prefix, symbol after it (0 for the end) and how often, over all places of some values."""
    raw = np.frombuffer("".join(values).encode("latin-1"), dtype=np.uint8)
    lengths = np.array([len(v) for v in values], dtype=np.int64)
    counts = lengths + 1
    first = np.cumsum(counts) - counts
    places = np.arange(int(counts.sum())) - np.repeat(first, counts)
    at = np.repeat(np.cumsum(lengths) - lengths, counts) + places
    symbols = np.where(places < np.repeat(lengths, counts), _SHAPES[np.append(raw, 0)[np.minimum(at, len(raw))]], np.uint64(0))
    steps = _placed(symbols, places)
    sums = np.cumsum(steps)
    before = sums - steps
    before -= np.repeat(before[first], counts)
    of = np.repeat(kinds, counts).astype(np.int64)
    _, some, n = np.unique(before + steps + textbytes.mix(of.astype(np.uint64)), return_index=True, return_counts=True)
    return {"kind": of[some], "prefix": before.view(np.int64)[some], "symbol": symbols[some].astype(np.int64), "n": n.astype(np.int64)}


def _counted(values: DataFrame, ddl: str, make: Callable[[np.ndarray, list[str]], dict]) -> DataFrame:
    """The columns that make counts over slices of (kind, value)."""
    names = fields(ddl).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, first = text_column(batch, "kind").to_numpy(), 0
            for texts in in_slices(text_column(batch, "value").to_pylist(), textbytes.SLICE):
                made = make(kinds[first : first + len(texts)], texts)
                first += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(made[c]) for c in names], names=names)

    return by_bytes(values).mapInArrow(run, ddl)


def _symbols(kinds: np.ndarray, values: list[str]) -> dict:
    counts = np.bincount(_SHAPES[np.frombuffer("".join(values).encode("latin-1"), dtype=np.uint8)].astype(np.int64), minlength=256)
    counts[0] = len(values)
    return {"symbol": np.flatnonzero(counts), "n": counts[counts > 0]}


def _structures(values: DataFrame) -> dict[int, list[dict[str, int]]]:
    """The moves of each kind's automaton, from the prefix tree of all its values."""
    places = {r[0]: r[1] for r in values.groupBy("kind").agg(F.sum(F.length("value") + 1)).collect()}
    small = [kind for kind, n in places.items() if n <= STATES]
    moves = _merged_in_rounds(values, sorted(places.keys() - set(small)))
    if small:
        ddl = "kind long, prefix long, symbol long, n long"
        counts = _counted(values.where(F.col("kind").isin(small)), ddl, _prefixes).groupBy("kind", "prefix", "symbol").agg(F.sum("n").alias("n"))
        nodes: dict[int, dict[int, dict[str, int]]] = {kind: {} for kind in small}
        for r in counts.toLocalIterator():  # at most STATES of a kind
            nodes[r.kind].setdefault(r.prefix, {})[chr(r.symbol) if r.symbol else ""] = r.n
        moves |= {kind: grammar.structure(x, _child) for kind, x in nodes.items()}
    return moves


def _visited(values: DataFrame, moves: dict[int, list[dict[str, int]]]) -> DataFrame:
    """The nodes that all values pass: how often, what follows how often, and (below a fringe state) the nodes where each accepted state comes by the same symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int, str], int] = {}
        about: dict[tuple[int, int], tuple] = {}
        held = 0

        def made() -> pa.RecordBatch:
            rows = [(kind, node, symbol, n, *about[kind, node]) for (kind, node, symbol), n in counts.items()]
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for kind, text in zip(text_column(batch, "kind").to_pylist(), text_column(batch, "value").to_pylist(), strict=True):
                for node, symbol, fringe, others in grammar.visits(moves[kind], text):
                    if (kind, node, symbol) not in counts:
                        held += 2 + len(others or ())
                        about[kind, node] = fringe, others
                    counts[kind, node, symbol] = counts.get((kind, node, symbol), 0) + 1
                    if held >= VISITS:
                        yield made()
                        counts, about, held = {}, {}, 0
        if counts:
            yield made()

    ddl = "kind long, node long, symbol string, n long, fringe long, others array<long>"
    names = fields(ddl).names
    counts = by_bytes(values).mapInArrow(run, ddl).groupBy("kind", "node", "symbol").agg(F.sum("n").alias("n"), F.first("fringe").alias("fringe"), F.first("others").alias("others"))
    after = F.map_from_entries(F.collect_list(F.struct("symbol", "n"))).alias("after")
    return counts.groupBy("kind", "node").agg(F.sum("n").alias("arrived"), after, F.first("fringe").alias("fringe"), F.first("others").alias("others"))


def _merged_in_rounds(values: DataFrame, kinds: list[int]) -> dict[int, list[dict[str, int]]]:
    """The moves that `grammar.structure` makes of the prefix trees of all values, without the trees: a walk through the moves so far gives the counts of the merged states."""
    moves: dict[int, list[dict[str, int]]] = {kind: [{}] for kind in kinds}
    bound = F.lit(grammar.hoeffding(grammar.ALPHA))
    share = lambda side, symbol: F.coalesce(F.col(f"after{side}")[symbol], F.lit(0)) / F.col(f"arrived{side}")
    allowed = bound * (1 / F.sqrt("arrived") + 1 / F.sqrt("arrived_2"))
    differ = F.exists(F.array_union(F.map_keys("after"), F.map_keys("after_2")), lambda s: F.abs(share("", s) - share("_2", s)) > allowed)
    left = kinds
    while left:
        nodes = _visited(values.where(F.col("kind").isin(left)), moves)
        # A node that one value passes differs from none, as the test allows it more than 1.
        nodes = written(nodes.where("arrived > 1 or node >= 0 and node = fringe"), "secret-nodes")
        fringe: dict[int, list[tuple[int, str]]] = {}
        for r in nodes.where("node >= 0 and node = fringe").select("kind", "node").orderBy("kind", "node").collect():  # states times symbols
            fringe.setdefault(r.kind, []).append((r.node // 256, chr(r.node % 256)))
        pairs = nodes.where("fringe >= 0 and arrived > 1").select("kind", "fringe", "arrived", "after", F.posexplode("others").alias("known", "other"))
        against = nodes.where("arrived > 1").select("kind", F.col("node").alias("other"), F.col("arrived").alias("arrived_2"), F.col("after").alias("after_2"))
        accepted = pairs.where("other < 0").join(F.broadcast(against.where("other < 0")), ["kind", "other"])
        below = pairs.where("other >= 0").join(against.where("other >= 0"), ["kind", "other"])
        found = accepted.unionByName(below).where(differ).select("kind", "fringe", "known").distinct().collect()  # fringe times accepted states
        apart = {(r.kind, r.fringe // 256, chr(r.fringe % 256), r.known) for r in found}
        drop(nodes)
        for kind, ats in fringe.items():
            merges, new = grammar.decided(ats, len(moves[kind]), lambda at, k, kind=kind: (kind, *at, k) in apart)
            for i, symbol in new:
                merges[i, symbol] = len(moves[kind])
                moves[kind].append({})
            for (i, symbol), k in merges.items():
                moves[kind][i][symbol] = k
        left = sorted(fringe)
    return moves


def _automata(values: DataFrame, moves: dict[int, list[dict[str, int]]]) -> dict[int, grammar.Automaton]:
    """Each kind's automaton with the shares of all its values."""

    def walks(kinds: np.ndarray, texts: list[str]) -> dict:
        counts: dict[int, dict[tuple[int, str], int]] = {kind: {} for kind in moves}
        for kind, text in zip(kinds.tolist(), texts, strict=True):
            grammar.walk(moves[kind], text, counts[kind])
        found = [(kind, state, symbol, n) for kind, x in counts.items() for (state, symbol), n in x.items()]
        return {name: pa.array([r[i] for r in found], type=t) for i, (name, t) in enumerate((("kind", pa.int64()), ("state", pa.int64()), ("symbol", pa.string()), ("n", pa.int64())))}

    counts = _counted(values, "kind long, state long, symbol string, n long", walks).groupBy("kind", "state", "symbol").agg(F.sum("n").alias("n"))
    found: dict[int, dict[tuple[int, str], int]] = {kind: {} for kind in moves}
    for r in counts.toLocalIterator():  # states times symbols
        found[r.kind][r.state, r.symbol] = r.n
    return {kind: grammar.weighted(moves[kind], x) for kind, x in found.items()}


def _in_order(bits: np.ndarray) -> np.ndarray:
    """The bits of doubles as integers of the same order, and back."""
    return bits ^ ((bits >> 63) & np.int64((1 << 63) - 1))


def _quantile(values: DataFrame, model: Formats) -> float:
    """The score that a share of LOWEST of all labelled values stays below, found 16 bits at a time."""

    def scores(kinds: np.ndarray, texts: list[str]) -> dict:
        return {"key": _in_order(np.array([model.score(x) for x in texts], dtype=np.float64).view(np.int64))}

    keys = written(_counted(values, "key long", scores), "secret-scores")
    left, found = int(LOWEST * keys.count()), 0
    for shift in (48, 32, 16, 0):
        for r in keys.groupBy(F.shiftright("key", shift).alias("head")).count().orderBy("head").toLocalIterator():  # at most 1 << 16 rows
            if left < r["count"]:
                found = r["head"]
                break
            left -= r["count"]
        keys = keys.where(F.shiftright("key", shift) == found)
    return float(_in_order(np.array([found], dtype=np.int64)).view(np.float64)[0])


def learn(scanned: DataFrame) -> Formats:
    """From all distinct values of each kind and all distinct candidates."""
    held = lambda column: scanned.select(F.explode(column).alias("x"))
    values = written(held("secrets").select(F.col("x.kind").cast("long").alias("kind"), F.col("x.value").alias("value")).distinct(), "secret-values")
    moves = _structures(values)
    if not moves:
        return formats({}, [])
    others = held("candidates").select(F.lit(0).cast("long").alias("kind"), F.col("x.value").alias("value")).distinct()
    shares = lambda texts: [(chr(r.symbol) if r.symbol else "", r.n) for r in _counted(texts, "symbol long, n long", _symbols).groupBy("symbol").agg(F.sum("n").alias("n")).collect()]
    model = formats(_automata(values, moves), shares(others) or shares(values))
    return model._replace(least=max(_quantile(values, model), 1e-9))


def add_spans(scanned: DataFrame, model: Formats) -> DataFrame:
    """The scanned documents with all spans (base ones and those of kind `format`) in place of the candidates."""

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for base, candidates in zip(text_column(batch, "base").to_pylist(), text_column(batch, "candidates").to_pylist(), strict=True):
            more = [{"kind": 3, "start": c["start"], "stop": c["start"] + len(c["value"])} for c in candidates if model.score(c["value"]) >= model.least]
            out.append(sorted(base + more, key=lambda x: (x["start"], x["kind"])) if more else base)
        return [pa.array(out, type=_SPAN_TYPE)]

    return add_columns(scanned, f"spans array<{SPAN}>", make).drop("candidates", "secrets")


def joined(spans: str) -> F.Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["stop"])), ",")


def redacted(docs: DataFrame, spans: str = "spans", text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The documents with each span, or run of overlapping spans, replaced by the mark. Documents without spans are kept as they are."""

    def make(batch: pa.RecordBatch) -> list:
        out = []
        for value, found in zip(text_column(batch, text).to_pylist(), text_column(batch, spans).to_pylist(), strict=True):
            if found:
                pieces, at = [], 0
                for x in found:
                    if x["start"] >= at:
                        pieces += [value[at : x["start"]], mark]
                    at = max(at, x["stop"])
                value = "".join(pieces) + value[at:]
            out.append(value)
        return [pa.array(out, type=pa.string())]

    return add_columns(docs, f"{text} string", make).select(*docs.columns)
