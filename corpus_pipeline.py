"""A corpus pipeline in five stages, each by one operator of gleaner.llm.

Quality rules, language identification and near-duplicate removal drop documents,
the secret scan rewrites texts, packing makes training sequences. Each stage
works on all that its predecessor kept and returns the columns of documents, the
last one pieces of sequences.

Edge cases: an empty table passes through all stages. A null or empty text fails
the quality rules. Rows without an id are never dropped as duplicates. Rows that
repeat an id are judged one by one; of those that are copies or near copies of each other
one stays. Texts of any length go through whole. Other columns, whatever their names,
stay up to the last stage, whose pieces have only columns of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import crf_lang, decision_list, packing, secret_scan, setsketch
from gleaner.llm.common import remainder
from gleaner.llm.queries import TOKENIZER
from gleaner.session import scratch_path
from gleaner.sources.tables import table

#: A text whose words speak for no language on average at this share is rejected.
LEAST_LANGUAGE_SCORE = 0.4
ORACLE_SQL = None


def _free(documents: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in documents.columns:
        name += "_"
    return name


def _same(frame: DataFrame, documents: DataFrame) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`") for c in documents.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from `labels`."""
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    out = _free(docs, "_quality")
    return _same(decision_list.judge(docs, rules, out=out).filter(F.col(out)["kept"]), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those of letters whose words agree on one often enough."""
    model = crf_lang.fit(docs, F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(False)))
    label, score = _free(docs, "_language"), _free(docs, "_language_score")
    judged = crf_lang.predict(docs, model, label=label, score=score)
    sure = (F.col(label) != crf_lang.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return _same(judged.filter(sure), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return _same(setsketch.keep_first(docs), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts replaced by a mark."""
    model = secret_scan.train(secret_scan.labelled_strings(docs))
    cleaned = secret_scan.redact(docs, model)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        cleaned = cleaned.withColumn("n_chars", changed)
    return _same(cleaned, docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, TOKENIZER, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup),
    ("secret_scan", secrets), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
