"""Scores that compare a text with counts over the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.vectors import let
from gleaner.scale import broadcast_if_small, over_history
from gleaner.scale.broadcasts import BROADCAST_ROWS
from gleaner.scale.frames import CHUNK_ROWS, Carry
from gleaner.session import materialise


def _grams(words, n: int):
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def trigrams(df: DataFrame, ident: str, text: str = "text", n: int = 3) -> DataFrame:
    """(ident, gram, times): the word n-grams of each text with their counts."""
    words = T.words_of(F.coalesce(F.col(text), F.lit("")))
    return (
        df.select(ident, F.explode(words if n == 1 else let(words, lambda w: _grams(w, n))).alias("gram"))
        .groupBy(ident, "gram")
        .agg(F.count("*").alias("times"))
    )


def gram_keys(df: DataFrame, ident: str, text: str = "text", n: int = 3) -> DataFrame:
    """(ident, gram_a, gram_b, times): the word n-grams of each row by a hash of 128 bits, counted inside the row."""

    def keys(words):
        gram = lambda i: [F.get(words, i + k) for k in range(n)]
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
        return F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(*gram(i)).alias("gram_a"), F.xxhash64(F.lit("gram"), *gram(i)).alias("gram_b"))))

    def runs(found):
        first = lambda i: (i == 0) | (F.get(found, i) != F.get(found, F.greatest(i - 1, F.lit(0))))
        return let(F.filter(F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)), first), lambda at: counted(found, at))

    def counted(found, at):
        ends = lambda k: F.coalesce(F.get(at, k + 1), F.size(found))
        return F.transform(at, lambda i, k: F.struct(F.get(found, i).getField("gram_a").alias("gram_a"), F.get(found, i).getField("gram_b").alias("gram_b"), (ends(k) - i).cast("long").alias("times")))

    words = T.words_of(F.coalesce(F.col(text), F.lit("")))
    each = df.select(ident, F.explode(let(let(words, keys), runs)).alias("_g"))
    return each.select(ident, "_g.*")


def _novelty(df: DataFrame, overlaps: DataFrame, ident: str, text: str, n: int) -> DataFrame:
    """1 - min(overlap / number of n-grams, 1) with the (ident, overlap) of matched n-grams; 0.5 for texts without any.

    The n-grams are counted inside the row, so those without a match need not travel.
    """
    size = F.greatest(F.size(T.words_of(F.coalesce(F.col(text), F.lit("")))) - (n - 1), F.lit(0)).cast("long")
    sizes = materialise(df.select(ident, size.alias("_own")))
    per_text = sizes.groupBy(ident).agg(F.sum("_own").alias("_n")).join(
        overlaps.groupBy(ident).agg(F.sum("overlap").alias("_overlap")), ident, "left"
    )
    share = F.least(F.coalesce("_overlap", F.lit(0)) / F.col("_n"), F.lit(1.0))
    return sizes.join(per_text, ident, "left").select(
        ident,
        F.coalesce("_n", F.lit(0)).alias("n_grams"),
        F.coalesce("_overlap", F.lit(0)).alias("overlap"),
        F.when(F.col("_n") > 0, 1.0 - share).otherwise(0.5).alias("novelty"),
    )


def ngram_novelty(df: DataFrame, seen: DataFrame, ident: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """Novelty of each text against a table `seen(gram, seen)` of counted n-grams.

    A small table goes to the tasks, and no n-gram travels. Else the n-grams travel once, for the join.
    """
    words = T.words_of(F.coalesce(F.col(text), F.lit("")))
    grams = df.select(ident, F.explode(let(words, lambda w: _grams(w, n))).alias("gram"))
    # written first: the join's exchanges then lie right below its sorts, and AQE can split a frequent n-gram
    matched = grams.join(broadcast_if_small(materialise(seen)), "gram")
    return _novelty(df, matched.select(ident, F.col("seen").alias("overlap")), ident, text, n)


def seen_ngrams(df: DataFrame, ident: str, text: str = "text", n: int = 3) -> DataFrame:
    return trigrams(df, ident, text, n).groupBy("gram").agg(F.sum("times").alias("seen"))


def ngram_novelty_ordered(
    df: DataFrame, ident: str = "doc_id", text: str = "text", n: int = 3, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Novelty of each text against all texts before it in id order.

    N-grams travel once, as a hash of 128 bits and counted per text; those seen before go on to their text.
    """
    grams = gram_keys(df, ident, text, n)
    if not df.groupBy(ident).agg(F.count("*").alias("_n")).filter("_n > 1").isEmpty():  # rows of one id are one text
        grams = materialise(grams.groupBy(ident, "gram_a", "gram_b").agg(F.sum("times").alias("times")))

    def build(d, w):
        mine = F.col("_chunk") == F.col("_home") if "_chunk" in d.columns else F.lit(True)
        before = F.sum(F.when(mine, F.col("times"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return d.withColumn("seen", F.coalesce(before, F.lit(0)) + F.coalesce("_past", F.lit(0)))

    counted = over_history(
        grams, ["gram_a", "gram_b"], ident, ident, 0, build, {"_past": Carry(F.sum("times"), "bigint")}, chunk_rows
    )
    matched = counted.filter("seen > 0").select(ident, (F.col("times") * F.col("seen")).alias("overlap"))
    return _novelty(df, matched, ident, text, n)


def unigram_perplexity(
    df: DataFrame, ident: str = "doc_id", text: str = "text", common_words: int = BROADCAST_ROWS
) -> DataFrame:
    """(ident, n_words, loss, perplexity) under the corpus unigram model with add-one smoothing.

    The totals are written. Those of the most frequent words, as many as may be
    broadcast, go to the tasks, so their occurrences do not travel, and no
    word is frequent enough to be a hot key. Only the occurrences of rarer
    words are joined by a shuffle. Losses are summed by text before they travel.
    """
    each = df.select(ident, F.explode(T.words_of(F.coalesce(F.col(text), F.lit("")))).alias("word"))
    words = materialise(each.groupBy("word").agg(F.count("*").alias("total")))
    vocabulary, tokens = words.agg(F.count("*"), F.sum("total")).first()
    if vocabulary <= common_words:
        parts = [each.join(broadcast_if_small(words), "word")]
    else:
        common = materialise(words.orderBy(F.col("total").desc(), "word").limit(common_words))
        rare = materialise(words.join(common, "word", "left_anti"))
        known = broadcast_if_small(common)
        parts = [each.join(known, "word"), each.join(known, "word", "left_anti").join(rare, "word")]
    loss = -F.log((F.col("total") + 1) / F.lit(float(vocabulary + (tokens or 0))))
    sums = [p.groupBy(ident).agg(F.count("*").alias("n_words"), F.sum(loss).alias("_loss")) for p in parts]
    both = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
    scored = both.groupBy(ident).agg(F.sum("n_words").alias("n_words"), (F.sum("_loss") / F.sum("n_words")).alias("loss"))
    return scored.withColumn("perplexity", F.exp("loss"))


def token_importance(df: DataFrame, ident: str, grad_norm: str) -> DataFrame:
    """min(mean token gradient norm / 10, 1) per text."""
    return df.groupBy(ident).agg(F.least(F.avg(grad_norm) / 10, F.lit(1.0)).alias("importance"))


def attention_coverage(df: DataFrame, ident: str, weight: str) -> DataFrame:
    """Entropy of the softmax of a text's attention weights over ln(count); 0 for a text with one weight.

    The largest weight of a text is taken off before `exp`, so weights of any
    size are fine. Partial aggregates per text replace a window over its rows.
    """
    tops = df.groupBy(ident).agg(F.max(weight).alias("_top"))
    shifted = df.join(tops, ident).withColumn("_e", F.exp(F.col(weight) - F.col("_top")))
    norms = shifted.groupBy(ident).agg(F.count("*").alias("_n"), F.sum("_e").alias("_s"))
    p = F.col("_e") / F.col("_s")
    entropy = -F.sum(p * F.log(p + 1e-8)) / F.log(F.greatest(F.max("_n"), F.lit(2)))
    return shifted.join(norms, ident).groupBy(ident).agg(F.when(F.max("_n") > 1, entropy).otherwise(0.0).alias("coverage"))
