"""Embedding whitening by block Golub-Kahan-Lanczos bidiagonalisation over distributed rows.

An entry c becomes the whole number x = floor(1024 * c) + 100000. C are the rows x centred on their mean: C = (n x - S) / n, with exact
n and S. `fit` bidiagonalises C: each step multiplies C by a block of right vectors (rows x block, one Spark job), orthogonalises the product
against all left vectors so far, multiplies the transposed C by the new left block (a second job) and orthogonalises that against all right vectors
so far. A left block is U = C W with a small W on the driver, so each job recomputes its rows' parts of U from the rows and no
table of left vectors is kept or joined. What reaches the driver are sums of at most (dimension + left vectors) x (left vectors + block)
numbers a step. The singular values of the small bidiagonal matrix are the deviations times sqrt(n), its right vectors turn the right blocks into
components. Steps end when the residuals of the wanted components vanish, or no new direction is left.

The block is at least as wide as the number of components, so that an eigenvalue that several components share is found as often as it is
wanted; a single starting vector would see it once.

Defined cases: vectors that are null, empty, or hold null or non-finite entries, or entries whose x is no long, give no rows. Vectors of each length
are fitted apart. Repeated rows count and come back as often as they occur. A component without variance (a deviation below 1e-7 of the
largest) is left out, so a single vector, or equal vectors only, give no rows. An empty table gives none. Of other columns only the key is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm.storage import written

SCALE = 1024.0
SHIFT = 100_000
COMPONENTS = 8
#: Right vectors that one pass over the rows multiplies.
BLOCK = 16
#: Residual, as a share of the largest singular value, at which a component counts as found.
RESIDUAL = 1e-14
#: Left directions shorter than this share of the largest singular value are rounding.
NO_VARIANCE = 1e-7


class Fit(NamedTuple):
    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dimension x count, unit columns
    eigenvalues: np.ndarray
    trace: float


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _scaled_differences(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n x - S, as 64-bit numbers where they fit, else as Python numbers."""
    largest = max(abs(int(x.max())), abs(int(x.min())), 1)
    if n * largest < 1 << 61 and max(map(abs, sums)) < 1 << 61:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return _scaled_differences(x, n, sums).astype(np.float64) / n


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """The exact sum over dimensions of (n x - S) ** 2 of each row."""
    d = _scaled_differences(x, n, sums)
    if d.dtype != object and int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of what part gives for a batch of them: each task adds up its batches, Spark adds up the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["slot", "value"])

    out = np.zeros(size)
    for slot, value in rows.select("x").mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value")).collect():
        out[slot] = value
    return out


def _exact_sums(rows: DataFrame, length: int) -> tuple[int, tuple[int, ...]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (length + 1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                if max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= 1 << 63:
                    x = x.astype(object)
                total = [a + int(b) for a, b in zip(total, [*x.sum(axis=0).tolist(), len(x)], strict=True)]
        values = pa.array([str(t) for t in total])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length + 1, dtype=np.int32)), values], names=["slot", "value"])

    out = [0] * (length + 1)
    parts = rows.select("x").mapInArrow(run, "slot int, value string")
    for slot, value in parts.groupBy("slot").agg(F.sum(F.col("value").cast("decimal(38,0)"))).collect():
        out[slot] = int(value)
    return out[length], tuple(out[:length])


def _orthonormal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of block's directions beyond those of basis; directions shorter than least are left out."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    left, sizes, _ = np.linalg.svd(block, full_matrices=False)
    new = left[:, sizes > least]
    new = new - basis @ (basis.T @ new)
    return np.linalg.qr(new)[0] if new.shape[1] else new


def fit(rows: DataFrame, length: int, components: int = COMPONENTS, block: int = BLOCK) -> Fit:
    """The leading components of rows (a column x of so many longs, read once for each product)."""
    n, sums = _exact_sums(rows, length)
    block = min(max(block, components), length)
    right = np.linalg.qr(np.random.default_rng(0).standard_normal((length, block)))[0]
    newest = right
    left = np.zeros((length, 0))  # U = C left
    projected = np.zeros((0, 0))  # transposed U times C times right
    trace = 0.0
    while True:
        both = np.hstack([left, newest])
        wide, old = both.shape[1], left.shape[1]

        def forward(x: np.ndarray, both: np.ndarray = both) -> np.ndarray:
            c = centred(x, n, sums)
            products = c @ both
            return np.append(products.T @ products, (c * c).sum())

        found = _summed(rows, forward, wide * wide + 1)
        trace = float(found[-1])
        gram = found[:-1].reshape(wide, wide)
        onto = np.linalg.solve(gram[:old, :old], gram[:old, old:]) if old else np.zeros((0, wide))
        rest = gram[old:, old:] - gram[old:, :old] @ onto
        sizes, turns = np.linalg.eigh((rest + rest.T) / 2)
        largest = max(np.sqrt(max(gram[old:, old:].diagonal().max(initial=0.0), 0.0)), np.linalg.norm(projected, 2) if projected.size else 0.0)
        kept = sizes > (NO_VARIANCE * largest) ** 2
        lengths = np.sqrt(sizes[kept])
        new_left = (newest - left @ onto) @ (turns[:, kept] / lengths)
        grown = np.zeros((old + new_left.shape[1], right.shape[1]))
        grown[:old, : projected.shape[1]] = projected
        grown[:old, projected.shape[1] :] = onto
        grown[old:, projected.shape[1] :] = (turns[:, kept] * lengths).T
        projected, left = grown, np.hstack([left, new_left])
        if not new_left.shape[1]:
            break

        def backward(x: np.ndarray, new_left: np.ndarray = new_left) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ new_left)

        product = _summed(rows, backward, length * new_left.shape[1]).reshape(length, -1)
        beyond = product - right @ (right.T @ product)
        beyond -= right @ (right.T @ beyond)
        turned = np.linalg.svd(projected)
        largest = turned[1][0]
        residuals = np.linalg.norm(beyond @ turned[0][old:, : min(components, len(turned[1]))], axis=0)
        if right.shape[1] == length or residuals.max() <= RESIDUAL * largest:
            break
        newest = _orthonormal(beyond, right, RESIDUAL * largest)
        if not newest.shape[1]:
            break
        right = np.hstack([right, newest])
    if not left.shape[1]:
        return Fit(n, sums, np.zeros((length, 0)), np.zeros(0), 0.0)
    _, deviation, turns = np.linalg.svd(projected)
    count = min(components, int((deviation > NO_VARIANCE * deviation[0]).sum()))
    vectors = right @ turns[:count].T
    return Fit(n, sums, vectors / np.linalg.norm(vectors, axis=0), deviation[:count] ** 2 / n, trace / n)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, measured on all rows."""
    turn = model.components / np.sqrt(model.eigenvalues)
    count = turn.shape[1]

    def part(x: np.ndarray) -> np.ndarray:
        y = centred(x, model.n, model.sums) @ turn
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = _summed(rows, part, (count + 1) * count).reshape(count + 1, count) / model.n
    return float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(count)).max())


def _whitened(rows: DataFrame, model: Fit, key: str) -> DataFrame:
    error = identity_error(rows, model)
    turn = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace
    count = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            size = len(x) * count
            each = pa.array(np.repeat(np.arange(len(x)), count))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.n, dtype=np.int64)),
                    pa.array([str(d) for d in deviations(x, model.n, model.sums)]).take(each),
                    pa.array((centred(x, model.n, model.sums) @ turn).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(size, error)),
                ],
                names=["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["_key"].dataType.simpleString()
    out = rows.select("_key", "x").mapInArrow(
        run, f"_key {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    )
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("_key", key)


def whiten(
    table: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), one row for each usable vector and component.

    deviation is a decimal(38,0): the exact sum does not fit a long on very large tables.
    """
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < float(1 << 62))
    rows = table.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", entry))
    rows = rows.select("_key", F.transform("_v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    rows = written(rows, "whitening-rows")
    parts = []
    for (length,) in rows.select(F.size("x")).distinct().orderBy("size(x)").collect():
        some = rows.filter(F.size("x") == length)
        model = fit(some, length, components, block)
        if len(model.eigenvalues):
            parts.append(_whitened(some, model, key))
    if not parts:
        kind = table.schema[key].dataType.simpleString()
        ddl = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], ddl)
    return reduce(DataFrame.unionByName, parts)
