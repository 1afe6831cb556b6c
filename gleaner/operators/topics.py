"""Topics found from the texts themselves."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, StopWordsRemover, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.session import materialise

HELD_WORDS = 200_000
SLICE_COUNTS = 1_000_000


def _bytes_of(text: str) -> Column:
    """The lower-cased text in UTF-8, whose bytes.split parts at exactly the white space of `functions.text.words_of`."""
    return F.coalesce(F.lower(F.col(text)), F.lit("")).cast("binary")


def frequent_terms(df: DataFrame, text: str, terms: int) -> list[str]:
    """The most frequent words that are no stop words, by count and then by word. A task counts its texts and passes on at most
    about `HELD_WORDS` words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        held = Counter()
        for batch in batches:
            for t in batch.column(0):
                held.update(t.as_py().split())
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    counted = df.select(_bytes_of(text).alias("_t")).mapInArrow(count, "word binary, n bigint")
    named = counted.groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))
    kept = named.filter(~F.col("word").isin(StopWordsRemover.loadDefaultStopWords("english")))
    return [r["word"] for r in kept.orderBy(F.col("n").desc(), "word").limit(terms).collect()]


def term_counts(df: DataFrame, vocabulary: list[str], ident: str, text: str) -> DataFrame:
    """(ident, tf): how often each term of the vocabulary occurs in a text, as a vector."""
    place, width = {w.encode(): k for k, w in enumerate(vocabulary)}, len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, SLICE_COUNTS // width)
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                some = batch.slice(a, most)
                counts = np.zeros((some.num_rows, width))
                for row, t in zip(counts, some.column(1), strict=True):
                    found = Counter(map(place.get, t.as_py().split()))
                    found.pop(None, None)
                    row[list(found)] = list(found.values())
                offsets = pa.array(np.arange(some.num_rows + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, pa.array(counts.ravel()))], names=["_id", "_tf"])

    rows = df.select(F.col(ident).alias("_id"), _bytes_of(text).alias("_t"))
    kind = rows.schema["_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"_id {kind}, _tf array<double>").select("_id", array_to_vector("_tf").alias("_dense"))
    # the assembler keeps a vector sparse where that is shorter; without the hint it would read rows to learn the length
    sized = VectorSizeHint(inputCol="_dense", size=width, handleInvalid="optimistic").transform(counted)
    sparse = VectorAssembler(inputCols=["_dense"], outputCol="tf").transform(sized)
    return sparse.select(F.col("_id").alias(ident), "tf")


def lda_topics(
    df: DataFrame, k: int, ident: str = "doc_id", text: str = "text", terms: int = 100, iterations: int = 10
) -> DataFrame:
    """(ident, topic, shares): LDA over the TF-IDF of the most frequent terms, fit on all texts.

    The texts are read twice, once for the vocabulary and once for the counts of its terms; the rest works on those counts.
    """
    vocabulary = frequent_terms(df, text, terms)
    if not vocabulary:
        raise ValueError("no terms in the texts")
    counts = materialise(term_counts(df, vocabulary, ident, text))
    weighted = materialise(IDF(inputCol="tf", outputCol="features").fit(counts).transform(counts).select(ident, "features"))
    model = LDA(k=k, seed=42, maxIter=iterations, optimizer="online").fit(weighted)
    shares = model.transform(weighted).select(ident, vector_to_array("topicDistribution").alias("shares"))
    return shares.select(ident, V.argmax(F.col("shares")).alias("topic"), "shares")
