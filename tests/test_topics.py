"""Topics: vocabulary and term counts against Spark's own, and how often the texts are read."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import topics


def test_terms_and_counts_are_those_of_the_words(spark, folder, monkeypatch):
    odd = [(-1, "the Cat sat\x0bon\fTHE mat\r\ncat   Ärger ÄRGER"), (-2, None), (-3, ""), (-4, " the a of ")]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    words = docs.select("doc_id", T.words_of(F.lower(F.coalesce("text", F.lit("")))).alias("words"))
    kept = StopWordsRemover(inputCol="words", outputCol="kept").transform(words)
    counted = kept.select(F.explode("kept").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    expected = [r["w"] for r in counted.orderBy(F.col("n").desc(), "w").limit(100).collect()]
    monkeypatch.setattr(topics, "HELD_WORDS", 50)
    assert topics.frequent_terms(docs, "text", 100) == expected
    vocabulary = [*expected, "cat sat", "ärger"]
    monkeypatch.setattr(topics, "SLICE_COUNTS", 500)
    model = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="kept", outputCol="tf")
    right = model.transform(kept).select("doc_id", vector_to_array("tf").alias("tf"))
    found = topics.term_counts(docs, vocabulary, "doc_id", "text").select("doc_id", vector_to_array("tf").alias("tf"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, right.collect()))


def test_texts_are_read_twice(spark, folder):
    read = spark.sparkContext.accumulator(0)

    def seen(text: str) -> str:
        read.add(1)
        return text

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.udf(seen, "string")("text").alias("text"))
    found = topics.lda_topics(docs, k=3, iterations=2)
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert found.count() == n and read.value <= 2 * n
