"""Best-fit packing of token sequences by minimum bin slack.

`tokenized` turns documents into pieces of at most `capacity` tokens, `pack` gives each piece a sequence and an offset,
`sequences` puts the pieces' ids together.

A packing depends only on how many pieces have each length, so `plan` works on that histogram (at most `capacity`
numbers, all that reaches the driver): a bin takes the longest length left and the fullest combination of
available lengths that fits beside it, found by subset sums in the bits of an integer; the combination is taken as often
as its lengths last. The pieces of each length are then numbered in parallel, in buckets by a hash, and the number tells the bin
and the place in it.

Defined cases: a null or empty text is the end token alone; an empty table gives no pieces; repeated rows and repeated ids are packed
each; other columns of the pieces are kept, and columns named sequence_id or offset are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regioflux.llm.arrow import add_columns, by_bytes, text_column
from regioflux.llm.byte_level import byte_level, in_slices
from regioflux.llm.storage import written

#: Characters of text that are tokenized together.
SLICE = 1 << 18
BUCKETS_PER_PARTITION = 8
#: Buckets whose counts are summed up together before the sums over all buckets.
BUCKETS_TOGETHER = 32


def tokenized(docs: DataFrame, tokenizer: str, end: int = 2, capacity: int = 1024, text: str = "text") -> DataFrame:
    """Pieces of the documents: their other columns, piece, start, length, and ids as little-endian 32-bit numbers.

    A document is its ids and the end token. One of more than `capacity` ids is cut so that only its first piece may be shorter.
    tokenizer: path of a tokenizer file that every worker can read. The content of an added token, such as <|endoftext|>, becomes that token.
    """
    kept = [f for f in docs.schema if f.name.lower() not in {text.lower(), "piece", "start", "length", "ids"}]
    schema = T.StructType([*kept, *T.StructType.fromDDL("piece int, start long, length long, ids binary")])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(tokenizer, added=True)
        for batch in batches:
            first = 0
            for texts in in_slices([t or "" for t in text_column(batch, text).to_pylist()], SLICE):
                ids, totals = encoder.encode_all(texts)
                ids = np.insert(ids, np.cumsum(totals), end)
                totals = totals + 1
                pieces = -(-totals // capacity)
                row = np.repeat(np.arange(len(totals)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = totals - (pieces - 1) * capacity
                start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, head[row])
                offsets = np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                old = batch.slice(first, len(texts)).select(names).take(pa.array(row)) if names else None
                columns = [old.column(i) for i in range(len(names))] if names else []
                yield pa.RecordBatch.from_arrays([*columns, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data], names=schema.names)
                first += len(texts)

    return by_bytes(docs).mapInArrow(run, schema)


class Plan(NamedTuple):
    """Slots by length and number of the piece among those of its length: bin and offset of the first piece of each slot."""

    key: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int


#: Bits for the number of a piece among those of its length.
_NUMBER = 48


def _fullest(left: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, as many as are left of each, whose sum comes nearest to room without going over it."""
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room or not left[length]:
            continue
        copies, size = min(left[length], room // length), 1
        while copies:
            size = min(size, copies)
            steps.append((length, size, reach))
            reach = (reach | reach << length * size) & mask
            copies -= size
            size *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: list[int] = []
    for length, size, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * size
            total -= length * size
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    left = {length: n for length, n in sorted(histogram.items(), reverse=True) if n}
    lengths = list(left)
    taken = dict.fromkeys(left, 0)
    keys, bins, offsets, count = [], [], [], 0
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        combination = [longest, *_fullest(left, lengths, capacity - longest)]
        left[longest] += 1
        uses = {x: combination.count(x) for x in combination}
        times = min(left[x] // n for x, n in uses.items())
        offset = 0
        for length in combination:
            keys.append(length << _NUMBER | taken[length])
            bins.append(count)
            offsets.append(offset)
            taken[length] += times
            offset += length
        for length, n in uses.items():
            left[length] -= n * times
        count += times
        lengths = [x for x in lengths if left[x]]
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    return Plan(*(np.array(x, dtype=np.int64)[order] for x in (keys, bins, offsets)), count)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with sequence_id and offset. Reads the pieces three times: give a written table.

    Pieces of a length are numbered within buckets by a hash of all columns, so that a length which most pieces share is
    spread over all tasks, and the buckets' counts are added up before. A length outside 1..capacity is an error.
    """
    pieces = pieces.drop("sequence_id", "offset")
    spark = pieces.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    right = F.col("length").between(1, capacity)
    length = F.when(right, F.col("length")).otherwise(F.raise_error(F.lit("a piece is empty or longer than the capacity")).cast("long"))
    rows = pieces.withColumn("_length", length).withColumn("_bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(buckets)).cast("int"))
    counts = written(rows.groupBy("_bucket", "_length").agg(F.count("*").alias("_n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("_length").agg(F.sum("_n")).collect()}  # capacity rows at most
    slots = plan(histogram, capacity)
    # Numbers before a bucket, in two levels, so that a length that all buckets hold is no one task's work.
    counts = counts.withColumn("_some", F.floor(F.col("_bucket") / BUCKETS_TOGETHER))
    before = lambda keys, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy("_length", "_some").agg(F.sum("_n").alias("_n")).select("_length", "_some", before(["_length"], "_some").alias("_first"))
    offsets = counts.withColumn("_before", before(["_length", "_some"], "_bucket")).join(sums, ["_length", "_some"])
    offsets = offsets.select("_bucket", "_length", (F.col("_before") + F.col("_first")).alias("_before"))
    within = Window.partitionBy("_bucket", "_length").orderBy(*pieces.columns)
    numbered = (
        rows.withColumn("_number", F.row_number().over(within) - 1)
        .join(offsets, ["_bucket", "_length"])
        .withColumn("_key", F.col("_length") * (1 << _NUMBER) + F.col("_number") + F.col("_before"))
        .drop("_bucket", "_length", "_number", "_before")
    )

    def make(batch: pa.RecordBatch) -> list:
        key = text_column(batch, "_key").to_numpy()
        at = np.searchsorted(slots.key, key, side="right") - 1
        return [slots.bin[at] + key - slots.key[at], slots.offset[at]]

    return add_columns(numbered, "sequence_id long, offset long", make).drop("_key")


def sequences(packed: DataFrame) -> DataFrame:
    """One row for each sequence with its ids; a sequence holds at most `capacity` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.transform(parts, lambda x: x["ids"]).alias("parts"), F.sum("length").alias("length"))
