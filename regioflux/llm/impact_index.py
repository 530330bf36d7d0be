"""Exact top-k search by integer inner product on an impact-ordered index, processed score at a time.

An entry c becomes the whole number floor(scale * c). The index deals all rows by a hash into shards of about SHARD rows. A shard is
one row of a written table: the ids, the whole vectors, and posting segments. A posting is a non-zero entry; its impact, the size of the
entry, is quantised to the power of two below it, and a segment holds the places of a shard's rows that have one impact in one dimension.

Queries go in chunks against shards, one task a pair. It adds up scores segment by segment, highest impacts first. What a row's
unprocessed entries can still add is at most the length of the query times the length of those entries (Cauchy and Schwarz), which the
index keeps per impact. Once the rows that can still be among the k best of their queries are few, processing stops, and just those rows are
scored exactly from their whole vectors. Rows without proof are never left out: where none comes, all segments are processed, and whatever
rounding leaves open is scored exactly.

Shards are searched in rounds of 1, 2, 4, ... shards. Each round starts from the k-th best scores of the rounds before, so a later shard
passes on only rows that reach them. A task holds one shard, one chunk and SHARD x TOGETHER scores. All queries meet all shards, so the work grows with
queries times rows; larger SHARD and CHUNK (both parameters) send less between executors and need more memory.

Defined cases: vectors that are null, empty, or hold null or non-finite entries, or entries whose whole number is not below 2 ** 31 in size, take no
part, nor do rows without an id. Only vectors of one length meet. An id's rows are never candidates of its own queries. Rows that repeat an id
and a vector count once; of an id with several vectors each is a candidate, and its queries share one list. Ties go to the smaller
id. A score that fits no long is an error. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regioflux.llm.storage import written

#: Rows of a shard, about, and queries of a chunk.
SHARD = 1 << 14
CHUNK = 1 << 11
#: Queries that are processed together.
TOGETHER = 64
#: Processing stops when at most so many rows a query, and three times k, can still be members: scoring those costs less than more segments.
FEW = 64
#: What sums of doubles can be off, as a share of the lengths' product, and what a root can be off.
ROUNDING = 1e-11


def _packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def segments(vectors: np.ndarray) -> dict[str, bytes]:
    """The posting segments of a shard's vectors, highest impacts first.

    heads has (impact, dimension, first posting) of each segment, places the rows of all postings, rests the length of each row's
    entries below each impact.
    """
    place, dimension = np.nonzero(vectors)
    impact = np.frexp(np.abs(vectors[place, dimension]).astype(np.float64))[1] - 1
    order = np.lexsort((place, dimension, -impact))
    place, dimension, impact = place[order], dimension[order], impact[order]
    new = np.ones(len(place), dtype=bool)
    new[1:] = (impact[1:] != impact[:-1]) | (dimension[1:] != dimension[:-1])
    first = np.flatnonzero(new)
    sizes = np.abs(vectors.astype(np.float64))
    rests = [np.sqrt(np.where(sizes < 2.0**level, sizes**2, 0).sum(axis=1)) for level in np.unique(impact)[::-1]]
    heads = np.stack([impact[first], dimension[first], first], axis=1).astype(np.int64)
    return {"heads": _packed(heads), "places": _packed(place.astype(np.uint32)), "rests": _packed(np.array(rests))}


class Shard:
    """One shard's index in memory."""

    def __init__(self, length: int, ids: bytes, vectors: bytes, heads: bytes, places: bytes, rests: bytes) -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.whole = np.frombuffer(vectors, np.int32).reshape(-1, length)
        self.vectors = self.whole.astype(np.float64)
        self.lengths = np.sqrt((self.vectors**2).sum(axis=1))
        self.heads = np.frombuffer(heads, np.int64).reshape(-1, 3)
        self.places = np.frombuffer(places, np.uint32)
        self.ends = np.append(self.heads[1:, 2], len(self.places))
        self.rests = np.frombuffer(rests, np.float64).reshape(-1, len(self.ids))

    def _open(self, scores: np.ndarray, level: int, own: np.ndarray, lengths: np.ndarray, floors: np.ndarray, k: int) -> np.ndarray:
        """Which rows can still be among the k best of which queries, with the segments down to a level processed."""
        rest = self.rests[level] + ROUNDING * self.lengths if level >= 0 else self.lengths * (1 + ROUNDING)
        rest = rest[:, None] * (lengths * (1 + ROUNDING))
        proven = floors
        if len(self.ids) >= k:
            least = scores - rest
            least[own] = -np.inf
            proven = np.maximum(floors, np.partition(least, len(self.ids) - k, axis=0)[len(self.ids) - k])
        may = scores + rest >= proven
        may[own] = False
        return may

    def search(self, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of every query that reach its floor."""
        weights = np.ascontiguousarray(queries.T.astype(np.float64))
        lengths = np.sqrt((weights**2).sum(axis=0))
        # Whole numbers below 2 ** 24 are added up exactly in single precision.
        exact_in = np.float32 if self.lengths.max(initial=0) * lengths.max(initial=0) < 1 << 23 else np.float64
        scores, entries, weights = np.zeros((len(self.ids), len(ids)), exact_in), self.vectors.astype(exact_in), weights.astype(exact_in)
        own = self.ids[:, None] == ids
        few = max(FEW, 3 * k)
        may = None
        levels = np.flatnonzero(np.diff(self.heads[:, 0], append=-1))
        some = slice(0, len(ids), max(1, len(ids) // 8))
        done = 0
        for level, last in enumerate(levels):
            for segment in range(done, last + 1):
                dimension = self.heads[segment, 1]
                at = self.places[self.heads[segment, 2] : self.ends[segment]]
                scores[at] += entries[at, dimension, None] * weights[dimension]
            done = last + 1
            # A look at some queries tells whether a proof for all is near.
            if done < len(self.heads) and self._open(scores[:, some], level, own[:, some], lengths[some], floors[some], k).sum(axis=0).mean() > few:
                continue
            may = self._open(scores, level, own, lengths, floors, k)
            if may.sum() <= few * len(ids):
                break
        if may is None:
            may = self._open(scores, -1, own, lengths, floors, k)
        row, query = np.nonzero(may)
        exact = self._exact(row, query, queries, float(lengths.max(initial=0)))
        order = np.lexsort((self.ids[row], -exact, query))
        row, query, exact = row[order], query[order], exact[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = (rank < k) & (exact >= floors[query])
        return query[best], row[best], exact[best]

    def _exact(self, row: np.ndarray, query: np.ndarray, queries: np.ndarray, longest: float) -> np.ndarray:
        wide = np.int64 if longest * float(self.lengths.max(initial=0)) < 2.0**62 else object
        out = np.zeros(len(row), dtype=wide)
        for a in range(0, len(row), 1 << 16):
            part = slice(a, a + (1 << 16))
            out[part] = (self.whole[row[part]].astype(wide) * queries[query[part]].astype(wide)).sum(axis=1)
        return out


def _usable(table: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float((1 << 31) - 1))
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fits))
    return rows.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def _dealt(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows with their length and a group's number, groups of about so many rows; and the number of groups for each length."""
    totals = {n: -(-c // size) for n, c in rows.groupBy(F.size("v")).count().collect()}
    numbers = F.create_map(*(F.lit(x) for pair in (totals or {0: 1}).items() for x in pair))
    number = F.pmod(F.xxhash64("id", "v"), numbers[F.size("v")].cast("long")).cast("int")
    return rows.withColumn("length", F.size("v")).withColumn(name, number), totals


def _distinct(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and places of a group's different rows."""
    ids = np.asarray(group["id"].combine_chunks())
    vectors = np.asarray(group["v"].combine_chunks().flatten(), dtype=np.int32).reshape(len(ids), -1)
    _, at = np.unique(np.hstack([ids[:, None], vectors]), axis=0, return_index=True)
    return ids[at], vectors[at], at


SHARD_COLUMNS = "ids binary, vectors binary, heads binary, places binary, rests binary"


def index(rows: DataFrame, size: int = SHARD) -> tuple[DataFrame, dict[int, int]]:
    """The shards (length, shard, ids, vectors, heads, places, rests), and how many there are of each length."""
    dealt, totals = _dealt(rows, size, "shard")

    def pack(group: pa.Table) -> pa.Table:
        ids, vectors, _ = _distinct(group)
        made = {"ids": _packed(ids), "vectors": _packed(vectors)} | segments(vectors)
        head = {"length": group["length"][:1], "shard": group["shard"][:1]}
        return pa.table(head | {name: pa.array([value], pa.binary()) for name, value in made.items()})

    return written(dealt.groupBy("length", "shard").applyInArrow(pack, f"length int, shard int, {SHARD_COLUMNS}"), "impact-index"), totals


def _chunks(queries: DataFrame, floors: DataFrame | None) -> DataFrame:
    """Queries packed by chunks, with the score each row must reach: (length, chunk, ids, vectors, floors)."""
    rows = queries.withColumn("floor", F.lit(None).cast("long")) if floors is None else queries.join(floors, "id", "left")
    lowest = np.iinfo(np.int64).min

    def pack(group: pa.Table) -> pa.Table:
        ids, vectors, at = _distinct(group)
        least = np.asarray(group["floor"].combine_chunks().fill_null(lowest))[at]
        made = {"ids": _packed(ids), "vectors": _packed(vectors), "floors": _packed(least)}
        head = {"length": group["length"][:1], "chunk": group["chunk"][:1]}
        return pa.table(head | {name: pa.array([value], pa.binary()) for name, value in made.items()})

    return rows.groupBy("length", "chunk").applyInArrow(pack, "length int, chunk int, ids binary, vectors binary, floors binary")


def _searched(shards: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the rows that each shard passes on for the queries of each chunk it meets."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            shard = Shard(row["length"], *(row[c] for c in ("ids", "vectors", "heads", "places", "rests")))
            row = right.to_pylist()[0]
            ids, floors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["floors"], np.int64)
            vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(ids), -1)
            for a in range(0, len(ids), TOGETHER):
                part = slice(a, a + TOGETHER)
                query, place, score = shard.search(ids[part], vectors[part], floors[part], k)
                out.append((ids[part][query], shard.ids[place], score))
        return pa.table([pa.array(np.concatenate(c).tolist(), pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "id", "score"])

    meet = ("length", "shard", "chunk")
    return shards.groupBy(*meet).cogroup(chunks.groupBy(*meet)).applyInArrow(search, "query_id long, id long, score long")


def top(
    table: DataFrame, is_query: F.Column, k: int, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, chunk: int = CHUNK
) -> DataFrame:
    """(query_id, rank, key, score): the k best rows for every row that is_query (over the key) selects, best first."""
    spark = table.sparkSession
    asked = table.select(F.col(key).cast("long").alias(key), is_query.alias("_asked")).filter("_asked").select(F.col(key).alias("id")).distinct()
    usable = _usable(table, key, vector, scale)
    shards, totals = index(usable, shard)
    queries, numbers = _dealt(usable.join(asked, "id", "left_semi"), chunk, "chunk")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = spark.createDataFrame([], "query_id long, id long, score long, rank int")
    floors, first, size = None, 0, 1
    while first < max(totals.values(), default=0) and numbers:
        lengths = {n: min(t, first + size) for n, t in totals.items() if t > first and n in numbers}
        if lengths:
            copies = spark.createDataFrame([(n, list(range(first, stop)), numbers[n]) for n, stop in lengths.items()], "length int, shards array<int>, chunks int")
            # One row for each length: which shards and chunks meet in this round.
            sent = shards.join(F.broadcast(copies), "length").filter(F.array_contains("shards", F.col("shard")))
            sent = sent.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("shards", "chunks")
            asking = _chunks(queries, floors).join(F.broadcast(copies), "length").withColumn("shard", F.explode("shards")).drop("shards", "chunks")
            found = _searched(sent, asking, k).unionByName(best.drop("rank")).distinct()
            best = written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "impact-best")
            floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        first, size = first + size, 2 * size
    return best.select("query_id", "rank", F.col("id").alias(key), "score")
