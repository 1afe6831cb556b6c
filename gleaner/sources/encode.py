"""Fixed-length token ids from a bounded vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.session import materialise

PAD, UNKNOWN, FIRST = 0, 1, 2
VOCABULARY = 50_257


def vocabulary(df: DataFrame, text: str = "text", size: int = VOCABULARY) -> DataFrame:
    """The `size` most frequent words with ids from 2, by count and then by word."""
    counts = (
        df.select(F.explode(T.words_of(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    top = counts.orderBy(F.col("n").desc(), "word").limit(size)
    ranked = top.withColumn("token", F.row_number().over(Window.orderBy(F.col("n").desc(), "word")) + FIRST - 1)
    return ranked.select("word", "token")


def encode_fixed(
    df: DataFrame, vocab: DataFrame, ident: str = "doc_id", text: str = "text", max_length: int = 512, held_words: int = 2_000_000
) -> DataFrame:
    """Token ids cut or padded to `max_length`, the mask, and labels = ids. A null text is all padding.

    Dictionary encoding inside Arrow batches: the distinct words of a batch are looked
    up once in the vocabulary, which a task holds, and the batch is coded by their
    places, so texts are never shuffled. A vocabulary of more than `held_words` words
    is split by a hash; each part codes the texts in a pass over the result of the last one.
    """
    vocab = materialise(vocab)
    parts = max(1, -(-vocab.count() // held_words))
    words = F.slice(T.words_of(F.col(text)), 1, max_length)
    coded = df.select(ident, words.alias("_w"), F.transform(words, lambda _: F.lit(UNKNOWN)).alias("_c"))
    for part in range(parts):
        own = vocab if parts == 1 else vocab.filter(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        coded = coded.withColumn("_c", _codes(own.toArrow())("_w", "_c"))
    codes = F.coalesce("_c", F.array().cast("array<int>"))
    out = coded.select(ident, codes.alias("_c")).withColumn("_n", F.size("_c"))
    fill = lambda v, n: F.array_repeat(F.lit(v), n)
    return out.select(
        ident, F.concat("_c", fill(PAD, F.lit(max_length) - F.col("_n"))).alias("input_ids"),
        F.concat(fill(1, F.col("_n")), fill(0, F.lit(max_length) - F.col("_n"))).alias("attention_mask"),
    ).withColumn("labels", F.col("input_ids"))


def _codes(vocab: pa.Table):
    """Codes of the words of each row; those outside the vocabulary keep the code they have."""
    words, tokens = vocab.column("word").combine_chunks(), vocab.column("token").combine_chunks().cast(pa.int32())

    @F.arrow_udf("array<int>")
    def codes(of: pa.Array, known: pa.Array) -> pa.Array:
        flat = pc.dictionary_encode(of.flatten())
        places = pc.index_in(flat.dictionary.cast(pa.string()), value_set=words.cast(pa.string()))
        found = pc.take(pc.take(tokens, places), flat.indices)
        merged = pc.coalesce(found, known.flatten().cast(pa.int32()))
        lengths = pc.fill_null(pc.list_value_length(of), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, merged)

    return codes
