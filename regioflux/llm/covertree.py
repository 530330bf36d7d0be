"""Embedding near-dedup: exact cosine-threshold links by a dual traversal of nested covers.

Unit vectors with cosine of at least t lie within sqrt(2 - 2 t) of each other. Vectors are covered in nested levels: by the nearest of a
few pivots, whose nodes are cut into blocks of about BLOCK vectors by a hash (so one dense spot fills many blocks), and inside each block by
balls of radius 1/2, 1/4 and 1/8, each within one of the level above. Every node knows its covering radius, the largest
distance it holds. Pairs of nodes are dropped when their centers are farther apart than the threshold distance and both radii;
the rest go on to their children, and pairs of vectors that remain are compared in double precision. So no link is lost and none is added.

Equal vectors are one vector with copies. Block pairs give sums of links and a forest of the vectors they connect, not the pairs
themselves, so a dense group costs comparisons but no rows. Where vectors are spread evenly in many dimensions no radius separates
blocks, and all block pairs are compared.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component;
vectors link with those of their own length only, one length after the other; components of any finite size count; repeated rows count as vectors
each; an empty table gives no rows; of other columns none is kept.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm.components import components
from regioflux.llm.storage import written

BLOCK = 4096
#: Most pivots of the top level: with their distances all that reaches the driver.
PIVOTS = 256
RADII = (0.5, 0.25, 0.125)
#: Allowed for rounding in bounds (not in the decision).
MARGIN = 1e-6
_ROWS = 512


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _matrix(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.float64).reshape(len(cells), -1)


class _Cover(NamedTuple):
    """A level of a block: center (row) of each node, covering radius, and the rows' nodes."""

    centers: np.ndarray
    radius: np.ndarray
    node: np.ndarray


def covers(x: np.ndarray) -> list[_Cover]:
    """Balls of RADII over unit vectors, each level inside the one above; a row joins the first center near enough."""
    levels, parent = [], np.zeros(len(x), dtype=np.int64)
    for radius in RADII:
        center_of = np.full(len(x), -1, dtype=np.int64)
        far = np.zeros(len(x))
        for p in range(int(parent.max()) + 1 if len(x) else 0) if len(levels) else [0]:
            left = np.flatnonzero(parent == p) if levels else np.arange(len(x))
            while len(left):
                head = left[:_ROWS]
                near = _distances(x[head], x[left]) <= radius
                taken = np.zeros(len(left), dtype=bool)
                for i in range(len(head)):
                    if not taken[i]:
                        mine = near[i] & ~taken
                        mine[i] = True
                        taken |= mine
                        center_of[left[mine]] = head[i]
                        far[left[mine]] = _distances(x[head[i]][None], x[left[mine]])[0]
                left = left[~taken]
        centers, node = np.unique(center_of, return_inverse=True)
        most = np.zeros(len(centers))
        np.maximum.at(most, node, far)
        most[np.bincount(node, minlength=len(centers)) == 1] = 0.0
        levels.append(_Cover(centers, most, node))
        parent = node
    return levels


def _stored(levels: list[_Cover]) -> dict[str, np.ndarray]:
    """A level as two columns: each row's center (row number in its block) and that node's radius."""
    out = {}
    for i, level in enumerate(levels):
        out[f"c{i}"] = level.centers[level.node]
        out[f"r{i}"] = level.radius[level.node]
    return out


def _node_pairs(p: pd.DataFrame, q: pd.DataFrame, x: np.ndarray, y: np.ndarray, near: float, same: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of the smallest node pairs that the bounds leave, from the top level down."""

    def nodes(f: pd.DataFrame, level: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        centers, at = np.unique(f[f"c{level}"].to_numpy()[rows], return_inverse=True)
        order = np.argsort(at, kind="stable")
        members = np.split(rows[order], np.flatnonzero(np.diff(at[order])) + 1)
        return centers, np.array([f[f"r{level}"].to_numpy()[m[0]] for m in members]), members

    pairs = [(np.arange(len(p)), np.arange(len(q)))]
    for level in range(len(RADII)):
        kept = []
        for a, b in pairs:
            alike = same and a[0] == b[0]  # a node met with itself: each pair of its children counts once
            ca, ra, ma = nodes(p, level, a)
            cb, rb, mb = nodes(q, level, b)
            for start in range(0, len(ca), _ROWS):
                part = slice(start, start + _ROWS)
                close = _distances(x[ca[part]], y[cb]) <= near + ra[part, None] + rb[None, :] + MARGIN
                for i, j in zip(*np.nonzero(close), strict=True):
                    if not alike or start + i < j or (start + i == j and len(mb[j]) > 1):
                        kept.append((ma[start + i], mb[j]))
        pairs = kept
    return pairs


def _forest(link: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a link matrix between vectors a and b connects, at most one for each vector."""
    rows, columns = np.flatnonzero(link.any(1)), np.flatnonzero(link.any(0))
    m = link[np.ix_(rows, columns)]
    of_row, of_column = a[rows].copy(), b[columns].copy()
    big = np.iinfo(np.int64).max
    while True:
        new_row = np.minimum(of_row, np.where(m, of_column[None, :], big).min(1))
        new_column = np.minimum(of_column, np.where(m, new_row[:, None], big).min(0))
        if (new_row == of_row).all() and (new_column == of_column).all():
            break
        of_row, of_column = new_row, new_column
    return [(int(u), int(v)) for u, v in zip(np.append(a[rows], b[columns]), np.append(of_row, of_column), strict=True) if u != v]


def compare(p: pd.DataFrame, q: pd.DataFrame, cosine: float, same: bool) -> pd.DataFrame:
    """(node, links, root) of the vectors of two blocks that have links: sums of copies, and a vector each is connected with."""
    x, y = _matrix(p.x), _matrix(q.x)
    lx, ly = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    ids_p, ids_q = p.node.to_numpy(), q.node.to_numpy()
    copies_p, copies_q = p.copies.to_numpy(), q.copies.to_numpy()
    links_p, links_q = np.zeros(len(p), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
    edges: list[tuple[int, int]] = []
    for a, b in _node_pairs(p, q, x / lx[:, None], y / ly[:, None], math.sqrt(max(2 - 2 * cosine, 0)), same):
        for start in range(0, len(a), _ROWS):
            rows = a[start : start + _ROWS]
            link = (x[rows] @ y[b].T) / (lx[rows, None] * ly[None, b]) >= cosine
            if same:
                link &= ids_p[rows][:, None] != ids_q[b][None, :]
            if link.any():
                links_p[rows] += link @ copies_q[b]
                if not same or a[0] != b[0]:
                    links_q[b] += copies_p[rows] @ link
                edges += _forest(link, ids_p[rows], ids_q[b])
    nodes, links = np.append(ids_p, ids_q), np.append(links_p, links_q)
    some = links > 0
    out = pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[some]})
    more = pd.DataFrame(edges, columns=["node", "root"], dtype="int64").assign(links=0)
    return pd.concat([out, more])[["node", "links", "root"]].astype("int64")


def _binary(vector: str) -> F.Column:
    """A vector as little-endian doubles, through an Arrow batch."""

    @F.pandas_udf("binary")
    def pack(cells: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(c, dtype="<f8").tobytes() for c in cells])

    return pack(F.col(vector))


def groups(table: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    rows = table.select(F.col(key), F.col(vector).cast("array<double>").alias("_v"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    right = F.col("_v").isNotNull() & F.forall("_v", finite) & F.exists("_v", lambda c: c != 0)
    rows = rows.withColumn("_right", F.coalesce(right, F.lit(False)))
    rows = rows.withColumn("_print", F.when(F.col("_right"), F.struct(F.xxhash64("_v").alias("a"), F.xxhash64("_v", F.lit(1)).alias("b"))))
    known = rows.filter("_right").groupBy("_print").agg(F.min(key).alias("node"), F.count("*").alias("copies"), F.min("_v").alias("v"))
    # Squares of very large or small components would leave the range of doubles; powers of two change no digit.
    most = F.array_max(F.transform("v", F.abs))
    factor = F.when(most > 2.0**400, 2.0**-600).when(most < 2.0**-400, 2.0**600).otherwise(1.0)
    known = known.withColumn("v", F.transform("v", lambda c: c * factor)).select("_print", "node", "copies", _binary("v").alias("x"))
    known = written(known, "vectors")
    # Vectors of each length are compared among themselves.
    sizes = [n for (n,) in known.select(F.length("x")).distinct().collect()]
    links = [_links(known.filter(F.length("x") == n), cosine) for n in sorted(sizes)]
    none = known.sparkSession.createDataFrame([], "node long, links long, root long")
    found = written(reduce(DataFrame.union, links, none), "vector-links")
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    by_print = known.join(counts, "node", "left").join(joined, "node", "left").select(
        "_print", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "node").alias("_component")
    )
    out = rows.select(key, "_print").join(by_print, "_print", "left")
    component = F.coalesce("_component", key)
    return out.select(key, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col(key) == component).alias("kept"))


def _links(vectors: DataFrame, cosine: float) -> DataFrame:
    spark = vectors.sparkSession
    total = vectors.count()
    wanted = min(PIVOTS, max(1, -(-total // BLOCK)))
    chosen = vectors.orderBy(F.xxhash64("node"), "node").limit(wanted).select("x").collect()
    if not chosen:
        return spark.createDataFrame([], "node long, links long, root long")
    pivots = _unit(np.stack([np.frombuffer(r[0], dtype="<f8") for r in chosen]))

    def assign(batches):
        for f in batches:
            if len(f):
                d = _distances(_unit(_matrix(f.x)), pivots)
                yield f.assign(pivot=d.argmin(1).astype("int32"), far=d.min(1))[["node", "copies", "x", "pivot", "far"]]

    assigned = written(vectors.select("node", "copies", "x").mapInPandas(assign, "node long, copies long, x binary, pivot int, far double"), "vector-nodes")
    sizes = {r[0]: (r[1], r[2]) for r in assigned.groupBy("pivot").agg(F.count("*"), F.max("far")).collect()}  # PIVOTS rows
    parts = {p: -(-n // BLOCK) for p, (n, _) in sizes.items()}
    first, count = {}, 0
    for p in sorted(parts):
        first[p], count = count, count + parts[p]
    lists = F.array(*(F.lit(first.get(p, 0)) for p in range(len(pivots)))), F.array(*(F.lit(parts.get(p, 1)) for p in range(len(pivots))))
    part = F.pmod(F.xxhash64("node"), F.get(lists[1], "pivot").cast("long")).cast("int")
    placed = assigned.select((F.get(lists[0], "pivot") + part).alias("block"), "node", "copies", "x")

    def build(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", ignore_index=True)
        return f.assign(**_stored(covers(_unit(_matrix(f.x)))))

    cover_columns = ", ".join(f"c{i} long, r{i} double" for i in range(len(RADII)))
    blocks = written(placed.groupBy("block").applyInPandas(build, f"block int, node long, copies long, x binary, {cover_columns}"), "vector-blocks")
    near = math.sqrt(max(2 - 2 * cosine, 0))
    d = _distances(pivots, pivots)
    open_pairs = [(p, q) for p in sizes for q in sizes if p <= q and d[p, q] <= near + sizes[p][1] + sizes[q][1] + MARGIN]
    pairs = spark.createDataFrame([(first[p], parts[p], first[q], parts[q]) for p, q in open_pairs], "p long, np long, q long, nq long")
    pairs = pairs.select(F.explode(F.sequence("p", F.col("p") + F.col("np") - 1)).alias("p"), "q", "nq")
    pairs = pairs.select("p", F.explode(F.sequence("q", F.col("q") + F.col("nq") - 1)).alias("q")).filter("p <= q")
    sides = pairs.select("p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
    sent = blocks.join(sides, "block")

    def match(f: pd.DataFrame) -> pd.DataFrame:
        p, q = int(f.p.iloc[0]), int(f.q.iloc[0])
        f = f.sort_values(["block", "node"], ignore_index=True)
        one = f[f.block == p].reset_index(drop=True)
        return compare(one, one if p == q else f[f.block == q].reset_index(drop=True), cosine, p == q)

    return sent.groupBy("p", "q").applyInPandas(match, "node long, links long, root long")
