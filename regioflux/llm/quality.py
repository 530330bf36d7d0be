"""Quality classifier: regularised quadratic discriminant over statistics of whole texts.

Each class has a mean and a covariance of the transformed statistics. A covariance is shrunk towards the pooled one and that
towards its diagonal, so it stays invertible with few rows. The score is the posterior of class 1 from the Mahalanobis
log-density difference, computed with the Cholesky factors that the model carries.

The class moments (count, sums, sums of products) cover all labelled rows and are added up by Spark; only d * d numbers a
class reach the driver. Defined cases: a null text counts as empty, and an empty text has statistics and so a score; an empty
table gives no rows; repeated rows are scored each; several labels of one document count by their mean (a half or more is 1);
null labels are ignored; without labelled rows of either class every score is that class's share (0.5 without any).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm import textbytes
from regioflux.llm.arrow import add_columns, text_column

#: Share of the pooled covariance in each class's, and of the diagonal in the pooled one.
POOLED = 0.1
DIAGONAL = 0.05
RIDGE = 1e-4

_KIND = np.full(256, 5, dtype=np.intp)  # lower, upper, digit, space, line end, symbol, plain mark, continuation
_KIND[0x61:0x7B] = 0
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 0x09, 0x0B, 0x0C]] = 3
_KIND[[0x0A, 0x0D]] = 4
_KIND[[ord(c) for c in ".,;:'\"?-()"]] = 6
_KIND[0x80:0xC0] = 7
_KIND[0xC0:] = 0
_BANG, _PIPE = ord("!"), ord("|")

NAMES = (
    "log_words", "word_length", "word_spread", "longest_word", "upper", "digit", "symbol", "mark", "bang", "pipe",
    "space", "lines", "distinct", "log_repeats", "repeated_lines", "symbol_words", "distinct_triples",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _distinct(prints: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values each owner has, and the count of the most frequent one."""
    if not len(prints):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((prints, owner))
    p, o = prints[order], owner[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, o[at], np.diff(np.append(at, len(p))))
    return np.bincount(o[at], minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES for each text, each value of moderate size and finite."""
    found = [_of_slice(part) for part in textbytes.slices(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(NAMES)))


def _of_slice(part: textbytes.Slice) -> np.ndarray:
    n = part.last - part.first
    sizes = np.diff(part.begins)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * 8 + _KIND[part.raw], minlength=n * 8).reshape(n, 8).astype(float)
    bang = np.bincount(owner[part.raw == _BANG], minlength=n)
    pipe = np.bincount(owner[part.raw == _PIPE], minlength=n)
    chars = kinds[:, :7].sum(1)
    w = textbytes.words(part)
    count = np.diff(w.first).astype(float)
    of = np.repeat(np.arange(n), np.diff(w.first))
    length = (w.ends - w.starts).astype(float)
    mean = _share(np.bincount(of, length, n), count)
    spread = np.sqrt(np.maximum(_share(np.bincount(of, length**2, n), count) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    prints = textbytes.fingerprints(w)
    distinct, most = _distinct(prints, of, n)
    triple, made = textbytes.shingles(prints, w.first, 3)
    triples, _ = _distinct(triple, np.repeat(np.arange(n), made), n)
    marked = np.bincount(of, (_KIND[w.data[w.ends - 1]] == 5) if len(w.ends) else None, n) if len(of) else np.zeros(n)
    ends = textbytes.words(part, inside=_LINE, lower=False)
    line_of = np.repeat(np.arange(n), np.diff(ends.first))
    lines, _ = _distinct(textbytes.fingerprints(ends), line_of, n)
    all_lines = np.bincount(line_of, minlength=n).astype(float)
    root = lambda a, b: np.sqrt(_share(a, b))
    return np.column_stack([
        np.log1p(count), np.log1p(mean), np.log1p(spread), np.log1p(longest), root(kinds[:, 1], chars), root(kinds[:, 2], chars),
        root(kinds[:, 5] - bang - pipe, chars), root(kinds[:, 6], chars), root(bang, chars), root(pipe, chars),
        root(kinds[:, 3], chars), root(kinds[:, 4], chars), np.log1p(distinct) - np.log1p(count), np.log1p(most) - np.log1p(count),
        _share(all_lines - lines, all_lines), root(marked, count), _share(triples, np.maximum(made, 1)),
    ])


_LINE = np.ones(256, dtype=bool)
_LINE[[0x0A, 0x0D]] = False


class Discriminant(NamedTuple):
    """Per class: log prior, mean, inverse Cholesky factor of the covariance, its log-determinant. constant: set if a class has no rows."""

    prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    logdet: np.ndarray
    constant: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = np.stack([self.prior[c] - 0.5 * (((x - self.mean[c]) @ self.factor[c].T) ** 2).sum(1) - 0.5 * self.logdet[c] for c in (0, 1)])
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def discriminant(count: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From the moments of classes 0 and 1: counts (2), sums (2, d), sums of products (2, d, d)."""
    d = sums.shape[1]
    if not count.all():
        share = count[1] / count.sum() if count.sum() else 0.5
        return Discriminant(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), float(share))
    mean = sums / count[:, None]
    own = products / count[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (own * count[:, None, None]).sum(0) / count.sum()
    pooled = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled)) + RIDGE * np.eye(d)
    lower = [np.linalg.cholesky((1 - POOLED) * c + POOLED * pooled) for c in own]
    factor = np.stack([np.linalg.inv(c) for c in lower])
    logdet = np.array([2 * np.log(np.diag(c)).sum() for c in lower])
    return Discriminant(np.log(count / count.sum()), mean, factor, logdet, None)


def add_statistics(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """The documents with their statistics as an array column."""

    def make(batch: pa.RecordBatch) -> list:
        x = statistics(text_column(batch, text))
        return [pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32), x.ravel())]

    return add_columns(docs, f"{name} array<double>", make)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", held_out=None) -> Discriminant:
    """Learns from all labelled rows for which held_out (a column of the key, or None) is false."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    if held_out is not None:
        known = known.filter(~held_out)
    known = known.groupBy(F.col(key).alias("_key")).agg((F.avg(label) >= 0.5).cast("int").alias("_class"))
    rows = stats.select(F.col(key).alias("_key"), F.col("stats")).join(known, "_key").select("_class", "stats")
    d = len(NAMES)

    def moments(batches):
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = np.column_stack([np.ones(len(x)), x])
            for k in (0, 1):
                total[k] += x[c == k].T @ x[c == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    cells = rows.mapInArrow(moments, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(2 * (d + 1) ** 2)
    for cell, value in cells:  # 2 * (d + 1) ** 2 rows, whatever the input
        total[cell] = value
    total = total.reshape(2, d + 1, d + 1)
    return discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def add_scores(stats: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """The rows of add_statistics with the posterior of class 1 in place of the statistics."""

    def make(batch: pa.RecordBatch) -> list:
        x = text_column(batch, "stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
        return [model.score(x)]

    return add_columns(stats, f"{name} double", make).drop("stats")


def score_texts(docs: DataFrame, model: Discriminant, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of the documents and their score, in one pass over the texts."""
    return add_columns(docs, f"{name} double", lambda batch: [model.score(statistics(text_column(batch, text)))])
