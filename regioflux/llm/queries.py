"""The registered queries of the thirteen operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regioflux.llm import alignment, covertree, decontaminate, html_text, impact_index, jaccard, licenses, packing, quality, secret_scan, toxicity, url_cascade, whitening
from regioflux.llm.storage import written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out_id(key: str = "doc_id") -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


@query()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality.add_statistics(docs).drop("text"), "quality-stats")
    model = quality.fit(stats, table(spark, sf_dir, "labels"), held_out=held_out_id())
    return quality.add_scores(stats, model).select(
        "doc_id",
        F.coalesce(held_out_id(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query()
def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = written(secret_scan.scan(docs).drop("text"), "secret-scan")
    found = secret_scan.add_spans(scanned, secret_scan.learn(scanned))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{secret_scan.KINDS[k]}") for k in range(3)),
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"),
        secret_scan.joined("spans").alias("spans"),
    )


TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
CAPACITY = 1024


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of the documents with a digest of their ids in place of the ids, packed."""
    pieces = packing.tokenized(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER), capacity=CAPACITY)
    return packing.pack(written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), CAPACITY)


@query()
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


JACCARD = jaccard.Rule(k=4, num=85, den=100)


@query(
    r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
    ), sizes AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM sets
    ), same AS (SELECT list_sort(s) AS s, n, min(doc_id) AS id FROM sizes WHERE n > 0 GROUP BY ALL
    ), held AS (SELECT id, n, unnest(s) AS shingle FROM same
    ), links AS (
        SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.shingle = b.shingle AND a.id <> b.id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
        GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), reach AS (
        SELECT id AS a, id AS b FROM same UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
    ), least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, d.n AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
    FROM sizes d LEFT JOIN same m ON m.s = list_sort(d.s) AND d.n > 0 LEFT JOIN least_id l ON l.a = m.id
    """
)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents").select("doc_id", "text"), JACCARD)


@query()
def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_spans = F.transform("spans", lambda x: x["label"])
    score = F.greatest(F.lit(0.0), F.array_max(F.transform("spans", lambda x: x["covered"])), F.when(F.size("base_places") > 0, 0.5))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places").alias("first_word"),
        F.array_max("base_places").alias("last_word"),
        F.array_join("base_names", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_names", of_spans))), ",").alias("labels"),
        F.least(F.lit(1.0), score).alias("score"),
    )


@query()
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.add_severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "severity", "toxic_score", (F.col("toxic_score") >= 0.5).cast("int").alias("toxic"))


#: Host, path and verdict of the base rules.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


@query(
    r"""
    WITH parsed AS (
        SELECT page_id,
               translate(coalesce(regexp_extract(url, '^(.|\n)*?://([^/?#]*)([^?#]*)', 2), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '^(.|\n)*?://([^/?#]*)([^?#]*)', 3), '') AS path
        FROM pages
    ), rules(rule_host, rule_path, verdict) AS (
        VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
               ('net', '/es/', 'block'), ('net', '/fr/', 'block')
    ), fits AS (
        SELECT p.page_id, p.host, p.path, max_by(r.rule_host || r.rule_path, length(r.rule_host || r.rule_path)) AS rule,
               max_by(r.verdict, length(r.rule_host || r.rule_path)) AS verdict
        FROM parsed p LEFT JOIN rules r
          ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
        GROUP BY ALL
    )
    SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
    FROM parsed p JOIN (SELECT DISTINCT host, path, rule, verdict FROM fits) f ON p.host = f.host AND p.path = f.path
    """
)
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_cascade.judge(table(spark, sf_dir, "pages"), rules)


@query(
    """
    WITH RECURSIVE vectors AS (
        SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM vectors UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
    ), least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id, coalesce(l.component_id, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN least_id l ON l.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id
    """
)
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.groups(table(spark, sf_dir, "embeddings"), cosine=0.9)


@query()
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text")


@query(
    """
    WITH rows AS (
        SELECT vec_id AS id, [floor(64 * x::DOUBLE) for x in embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT q.id AS query_id, c.id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM rows q JOIN rows c ON q.id <> c.id WHERE q.id % 20 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored
    QUALIFY rank <= 20
    """
)
def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_index.top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query()
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = alignment.aligned(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    return alignment.add_counts(written(found, "aligned")).drop("groups")


@query()
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))
