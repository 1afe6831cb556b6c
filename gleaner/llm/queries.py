"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    crf_lang, decision_list, hmm_lm, importance, license_scan, norm_search, packing, patched_blocks, secret_scan, setsketch, term_pipeline,
    tree_bpe, url_filter,
)
from gleaner.llm.common import remainder
from gleaner.session import scratch_path
from gleaner.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_crf_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(True))
    model = crf_lang.fit(documents, ~held_out)
    predicted = crf_lang.predict(documents.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = secret_scan.train(secret_scan.labelled_strings(documents))
    spans = F.col("_secrets")
    base = F.filter(spans, lambda s: s["kind"] < len(secret_scan.PATTERNS))
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [
        (F.size(spans) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
        for k, name in enumerate(secret_scan.KINDS)
    ]
    return secret_scan.scan(documents, model).select(
        "doc_id", *counts, F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(spans).alias("spans"),
    )


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    model = url_filter.fit(url_filter.labelled_urls(spark))
    return url_filter.judge(table(spark, folder, "pages").select("page_id", "url"), model).select("page_id", "_url.*")


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    rules = decision_list.fit(documents, table(spark, folder, "labels"))
    judged = decision_list.judge(documents.select("doc_id", "text"), rules)
    return judged.select("doc_id", "_quality.*")


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), TOKENIZER, with_ids=False)


@query
def op6_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return tree_bpe.digests(tree_bpe.encode(table(spark, folder, "documents"), TOKENIZER), TOKENIZER)


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    found = F.col("_licenses")
    families = F.transform(found, lambda x: x["family"])
    unknown = F.size(F.filter(families, lambda f: f == license_scan.UNKNOWN))
    return license_scan.scan(documents, license_scan.fit(documents)).select(
        "doc_id", F.col("_paragraphs").alias("n_paragraphs"), F.size(found).cast("long").alias("n_notices"),
        unknown.cast("long").alias("n_unknown"), F.concat_ws(",", F.array_sort(F.array_distinct(families))).alias("families"),
        F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["paragraph"], x["family"]))).alias("notices"),
    )


@query
def op8_hmm_score(spark: SparkSession, folder: str) -> DataFrame:
    return hmm_lm.score(table(spark, folder, "documents"))


@query
def op9_norm_search(spark: SparkSession, folder: str) -> DataFrame:
    return norm_search.top_inner(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op9_norm_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 5
"""


@query
def op10_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, folder, "documents")).withColumnRenamed("_id", "doc_id")


@query
def op11_patched_blocks(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    path = scratch_path(spark, "patched_blocks")
    patched_blocks.write(documents, TOKENIZER, path, end_id=2)
    kind = documents.schema["doc_id"].dataType
    return patched_blocks.read(spark, path).withColumn("doc_id", F.col("doc_id").cast(kind))


@query
def op12_term_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    kind = documents.schema["doc_id"].dataType
    found = term_pipeline.search(table(spark, folder, "benchmark"), documents)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op12_term_pipeline"] = rf"""
WITH q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
),
d AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
  ) GROUP BY doc_id, term
),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS len FROM d GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(len) AS BIGINT) AS terms FROM sizes),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM d WHERE term IN (SELECT term FROM q) GROUP BY term), whole
),
scored AS (
  SELECT item_id, doc_id,
    CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN d USING (term) JOIN w USING (term) JOIN sizes USING (doc_id), whole
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 20
"""


@query
def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    kind = documents.schema["doc_id"].dataType
    found = importance.resample(documents, table(spark, folder, "benchmark"))
    return found.select(F.col("_id").cast(kind).alias("doc_id"), "n_features", "weight", "score", "rank")


# crc32 of each distinct word from its bytes: a table of 256 remainders, then byte by byte
ORACLES["op13_importance"] = rf"""
WITH byte_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
),
d AS (
  SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
),
b AS (
  SELECT unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
),
words AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM d UNION SELECT word FROM b)),
buckets AS (
  SELECT word, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)])), 4294967295) % 10000 AS bucket
  FROM words, byte_table
),
counts AS (
  SELECT bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t
  FROM (SELECT bucket, count(*) AS s FROM d JOIN buckets USING (word) GROUP BY bucket)
  FULL JOIN (SELECT bucket, count(*) AS t FROM b JOIN buckets USING (word) GROUP BY bucket) USING (bucket)
),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    (CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM counts
),
weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
  FROM d JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM (SELECT doc_id FROM documents) LEFT JOIN weights USING (doc_id)
),
ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM ranks) THEN rank END AS rank
FROM scored LEFT JOIN ranks USING (doc_id)
"""
