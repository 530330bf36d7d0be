"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of the table that the stage before it has written; all but the last keep the columns
of documents. Defined cases: a null text counts as empty (the quality classifier decides on it, and it packs to the end token);
documents without an id are never near duplicates; rows of one id share their fate there; an empty table
passes through every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.llm import decontaminate, jaccard, quality, secret_scan
from regioflux.llm.queries import held_out_id, packed, table
from regioflux.llm.storage import written

#: Near duplicates share at least 0.8 of their shingles of five words.
NEAR = jaccard.Rule(k=5, num=4, den=5)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    stats = written(quality.add_statistics(docs.select("doc_id", "text")).drop("text"), "quality-stats")
    model = quality.fit(stats, table(spark, sf_dir, "labels"), held_out=held_out_id())
    return quality.score_texts(docs, model, name="_score").filter(F.col("_score") >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of every group of near duplicates."""
    groups = jaccard.groups(docs.select("doc_id", "text"), NEAR)
    dropped = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a test item."""
    found = decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"), name="_leaked")
    return found.filter("not _leaked").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in a text, and brings n_chars up to date there; all documents stay."""
    model = secret_scan.learn(written(secret_scan.scan(docs.select("doc_id", "text")).drop("text"), "secret-scan"))
    found = secret_scan.add_spans(secret_scan.scan(docs), model)
    kind = docs.schema["n_chars"].dataType
    return secret_scan.redacted(found).select(
        *(F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col(c)).cast(kind).alias(c) if c == "n_chars" else c for c in docs.columns)
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packed(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: The classifier's fit, the inferred formats and the tokenizer are not SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
