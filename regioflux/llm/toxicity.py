"""Toxicity: cumulative-link ordinal regression on sparse features of whole texts.

Features are the different words of a text and the different first four and five letters of its longer words (word forms
share their beginnings), by fingerprint. Severity grades 0 to 3 come from the sample's labels: 0 for a document labelled clean, and 1, 2, 3
for labelled ones by how many indicators they hold, cut at the thirds of the labelled ones. Indicators are features that occur
in labelled documents alone, in at least LEAST of them. The model has one weight for each feature, shared by all grades, and an ordered threshold for
each grade: P(grade <= j) = logistic(threshold_j - weights . features). The result is the expected grade.

Fitting uses at most SAMPLE labelled rows of each label, those with the smallest hashes of the key, and the FEATURES that tell
most about the label among those far more common in toxic documents; that is the only bound. All documents are scored on their whole text.

Defined cases: null and empty texts have no features and get the expected grade of the thresholds alone; null labels are ignored; several
labels of a document count as toxic if any is; repeated rows are scored each; without labelled rows of either kind every
expected grade is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regioflux.llm import textbytes
from regioflux.llm.arrow import add_columns, text_column
from regioflux.llm.storage import written

#: Bounds on the fit alone: labelled rows of each kind, and features with a weight.
SAMPLE = 4000
FEATURES = 1024
LEAST = 3
GRADES = 3
#: A feature tells something if its share among toxic documents is so many times that among clean ones.
RATIO = 4
STEPS = 300
DECAY = 1e-4

_LENGTHS = (4, 5)


def features(part: textbytes.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all features of a slice's texts, with repeats, and the text each is of."""
    found = textbytes.words(part, inside=textbytes.ALNUM)
    owner = np.repeat(np.arange(part.last - part.first), np.diff(found.first))
    values, owners = [textbytes.fingerprints(found)], [owner]
    for letters in _LENGTHS:
        heads, some = textbytes.prefixes(found, letters)
        values.append(textbytes.mix(textbytes.fingerprints(heads) + np.uint64(letters)))
        owners.append(owner[some])
    return np.concatenate(values), np.concatenate(owners)


class Severity(NamedTuple):
    """Known features with their weights, and the thresholds between grades; no features: every grade is 0."""

    known: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def expected(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of any grade above 0, for weights . features."""
        if not len(self.thresholds):
            return np.zeros(len(value)), np.zeros(len(value))
        above = _logistic(value[:, None] - self.thresholds[None, :])
        return above.sum(1), above[:, 0]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str) -> DataFrame:
    """(toxic, row, feature) of at most SAMPLE documents of each kind."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("toxic"))
    chosen = [known.filter(rule).orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE) for rule in (F.col("toxic") > 0, F.col("toxic") <= 0)]
    # At most 2 * SAMPLE pairs of numbers.
    ids = F.broadcast(written(chosen[0].union(chosen[1]), "toxicity-sample"))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(ids, "_key").select("_key", "toxic", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, toxic = batch.column(0), batch.column(1)
            for part in textbytes.slices(batch.column(2)):
                values, owner = features(part)
                order = np.lexsort((values, owner))
                values, owner = values[order], owner[order]
                new = np.ones(len(values), dtype=bool)
                new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                at = pa.array(owner[new] + part.first)
                yield pa.RecordBatch.from_arrays([keys.take(at), toxic.take(at), pa.array(values[new].view(np.int64))], names=["doc", "toxic", "feature"])

    kinds = labels.schema[key].dataType.simpleString(), labels.schema[label].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kinds[0]}, toxic {kinds[1]}, feature long").groupBy("doc", "toxic", "feature").agg(F.lit(1).alias("one")).drop("one")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Severity:
    rows = written(_sample(docs, labels, label, key, text), "toxicity-features")
    sizes = {bool(t): n for t, n in rows.select("doc", "toxic").distinct().groupBy(F.col("toxic") > 0).count().collect()}
    if len(sizes) < 2:
        return Severity(np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0))
    counts = rows.groupBy("feature").agg(
        F.sum((F.col("toxic") > 0).cast("long")).alias("hit"), F.sum((F.col("toxic") <= 0).cast("long")).alias("miss")
    ).filter(F.col("hit") + F.col("miss") >= LEAST)
    p, q = (F.col("hit") + 0.5) / (sizes[True] + 1), (F.col("miss") + 0.5) / (sizes[False] + 1)
    told = counts.filter(p >= RATIO * q).withColumn("told", (p - q) * (F.log(p) - F.log(q))).orderBy(F.desc("told"), "feature").limit(FEATURES).collect()
    known = np.array([r["feature"] for r in told], dtype=np.int64).view(np.uint64)
    indicator = np.array([r["miss"] == 0 and r["hit"] >= LEAST for r in told])
    number = {r["feature"]: i for i, r in enumerate(told)}
    # At most 2 * SAMPLE documents with those of the FEATURES that they hold.
    chosen = rows.join(F.broadcast(rows.sparkSession.createDataFrame([(int(x),) for x in number], "feature long")), "feature")
    held = chosen.groupBy("doc", "toxic").agg(F.sort_array(F.collect_list("feature")).alias("features")).orderBy("doc").collect()
    x = [np.array([number[f] for f in r["features"]], dtype=np.int64) for r in held]
    toxic = np.array([r["toxic"] > 0 for r in held])
    absent = {True: sizes[True] - int(toxic.sum()), False: sizes[False] - int((~toxic).sum())}
    x += [np.zeros(0, dtype=np.int64)] * (absent[True] + absent[False])
    toxic = np.concatenate([toxic, np.ones(absent[True], dtype=bool), np.zeros(absent[False], dtype=bool)])
    hits = np.array([indicator[i].sum() for i in x])
    cuts = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, hits, side="left"), 0)
    prior = labels.filter(F.col(label).isNotNull()).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0]
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    return Severity(known, *_fitted(x, grade, weight, len(known)))


def _fitted(x: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated gradient steps on the weighted likelihood; gaps between thresholds stay positive as exponentials."""
    column = np.concatenate(x) if len(x) else np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(x)), [len(i) for i in x])
    n = len(x)
    levels = GRADES
    p = np.zeros(d + levels)
    p[d] = 2.0
    first, second = np.zeros_like(p), np.zeros_like(p)
    high = grade[:, None] == np.arange(levels)[None, :]  # the threshold above the grade
    low = grade[:, None] == np.arange(1, levels + 1)[None, :]  # and the one below it
    for step in range(1, STEPS + 1):
        gaps = np.exp(p[d + 1 :])
        thresholds = p[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        value = np.bincount(row, p[column], n)
        c = _logistic(thresholds[None, :] - value[:, None])
        slope = c * (1 - c)
        up = np.where(grade < levels, (c * high).sum(1), 1.0)
        down = (c * low).sum(1)
        chance = np.maximum(up - down, 1e-9)
        by_threshold = weight[:, None] * slope * (high.astype(float) - low) / chance[:, None]
        gradient = np.zeros_like(p)
        gradient[:d] = np.bincount(column, (-by_threshold.sum(1))[row], d) / n - DECAY * p[:d]
        total = by_threshold.sum(0) / n
        tail = np.cumsum(total[::-1])[::-1]
        gradient[d] = tail[0]
        gradient[d + 1 :] = tail[1:] * gaps
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        p += 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def add_severity(docs: DataFrame, model: Severity, text: str = "text") -> DataFrame:
    """All columns of the documents, severity (expected grade, 0 to 3), and toxic_score (probability of a grade above 0)."""

    def make(batch: pa.RecordBatch) -> list:
        lookup = textbytes.Lookup(model.known)
        severity, score = [], []
        for part in textbytes.slices(text_column(batch, text)):
            n = part.last - part.first
            values, owner = features(part)
            number = lookup(values)
            some = number >= 0
            held = np.unique(owner[some] * (len(model.known) + 1) + number[some])
            value = np.bincount(held // (len(model.known) + 1), model.weights[held % (len(model.known) + 1)], n) if len(held) else np.zeros(n)
            for out, x in zip((severity, score), model.expected(value), strict=True):
                out.append(x)
        return [np.concatenate(severity), np.concatenate(score)]

    return add_columns(docs, "severity double, toxic_score double", make)
