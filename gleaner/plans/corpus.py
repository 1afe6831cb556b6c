"""Corpus, text score and stratification queries over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import dedup, metrics, novelty, select, stratify
from gleaner.plans.base import query
from gleaner.session import materialise, scratch_path
from gleaner.sources import encode
from gleaner.sources.tables import corpus, spread, table, text_metadata, write_metadata

# SQL fragments: `docs` (doc_id, text, ws = words), `scored` adds the scores.
DOCS = r"""
stripped AS (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents),
docs AS (
  SELECT doc_id, lang, text,
    list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws
  FROM stripped WHERE text <> ''),
measured AS (
  SELECT *, len(ws) AS n_words,
    len(list_filter(regexp_split_to_array(text, '[.!?]+(\s+|$)'), lambda x: x <> '')) AS n_sent,
    len(list_distinct(ws)) AS n_uniq
  FROM docs)
"""
SCORED = DOCS + r""",
scored AS (
  SELECT doc_id, lang, text, ws, n_words,
    least(
      (CASE WHEN n_words BETWEEN 50 AND 500 THEN 0.3::DOUBLE
            WHEN n_words BETWEEN 20 AND 49 OR n_words BETWEEN 501 AND 1000 THEN 0.2::DOUBLE
            ELSE 0.1::DOUBLE END)
      + (CASE WHEN n_sent > 1 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
      + (CASE WHEN n_words::DOUBLE / greatest(n_sent, 1) BETWEEN 10 AND 25 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)
      + least(n_uniq::DOUBLE / greatest(n_words, 1), 0.3::DOUBLE), 1.0::DOUBLE) AS quality,
    least((length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE / greatest(n_words, 1)) / 10, 1.0::DOUBLE) * 0.5::DOUBLE
      + least((n_words::DOUBLE / greatest(n_sent, 1)) / 30, 1.0::DOUBLE) * 0.5::DOUBLE AS complexity
  FROM measured)
"""
QUALITY_BIN = "least(floor(quality * 10.0::DOUBLE), 9)::INT"
COMPLEXITY_BIN = "least(floor(complexity * 5.0::DOUBLE), 4)::INT"


def _keywords(names: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{n}')::INT" for n in names)


_HITS = ", ".join(f"{_keywords(v)}" for v in T.TOPIC_KEYWORDS.values())
_NAMES = ", ".join(f"'{k}'" for k in T.TOPIC_KEYWORDS)
TOPIC = f"([{_NAMES}])[list_position([{_HITS}], list_max([{_HITS}]))]"
BAND = "CASE WHEN n_words < 50 THEN 'short' WHEN n_words < 200 THEN 'medium' ELSE 'long' END"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spread(table(spark, folder, "documents"), "doc_id"))


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    return text_metadata(documents(spark, folder))


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    """Scores without the text, written once: later steps read them several times."""
    return materialise(scored_documents(spark, folder).select("doc_id", "lang", "n_words", "quality", "complexity"))


# --- sources ------------------------------------------------------------------------


@query("corpus_load", f"WITH {DOCS} SELECT doc_id, text, n_words FROM measured")
def corpus_load(spark, folder):
    return documents(spark, folder).select("doc_id", "text", "n_words")


@query(
    "corpus_metadata",
    f"WITH {SCORED} SELECT doc_id, round(quality, 6) AS quality, round(complexity, 6) AS complexity, n_words FROM scored",
)
def corpus_metadata(spark, folder):
    scores = scored_documents(spark, folder).select("doc_id", "quality", "complexity", "n_words")
    kept = write_metadata(scores, scratch_path(spark, "metadata"))
    return kept.select("doc_id", F.round("quality", 6).alias("quality"), F.round("complexity", 6).alias("complexity"), "n_words")


@query(
    "split_head_tail",
    f"""WITH {DOCS}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS c FROM docs)
    SELECT doc_id, CASE WHEN rn > c - 100 THEN 'validation' ELSE 'train' END AS part FROM n""",
)
def split_head_tail(spark, folder):
    return select.split_head_tail(documents(spark, folder).select("doc_id"), "doc_id", 100)


MEMBERS = f"""
members AS (
  SELECT doc_id, 'quality_stratified' AS variant, {QUALITY_BIN}::VARCHAR AS stratum FROM scored
  UNION ALL SELECT doc_id, 'length_stratified', {BAND} FROM scored
  UNION ALL SELECT doc_id, 'domain_stratified', {TOPIC} FROM scored
  UNION ALL SELECT doc_id, 'complexity_stratified', {COMPLEXITY_BIN}::VARCHAR FROM scored),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY variant, stratum ORDER BY md5('0:' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY variant, stratum) AS size FROM members),
balanced AS (
  SELECT variant, stratum, doc_id FROM placed
  QUALIFY rn <= min(size) OVER (PARTITION BY variant)),
catalog AS (SELECT 'full' AS variant, 'all' AS stratum, doc_id FROM scored UNION ALL SELECT * FROM balanced)
"""


@query("variant_catalog", f"WITH {SCORED}, {MEMBERS} SELECT variant, stratum, doc_id FROM catalog")
def variant_catalog(spark, folder):
    path = scratch_path(spark, "catalog")
    _catalog(spark, folder).write.partitionBy("variant").parquet(path)
    return spark.read.parquet(path).select("variant", "stratum", "doc_id")


def _catalog(spark, folder):
    return stratify.variant_catalog(scored_documents(spark, folder))


@query(
    "catalog_metadata",
    f"""WITH {SCORED}, {MEMBERS}, sizes AS (SELECT variant, stratum, count(*) AS n FROM catalog GROUP BY ALL)
    SELECT variant, CASE WHEN variant = 'full' THEN 'base' ELSE 'stratified' END AS type,
      sum(n)::BIGINT AS size, count(*) AS num_strata,
      '{{' || string_agg('"' || stratum || '":' || n, ',' ORDER BY stratum) || '}}' AS strata_sizes
    FROM sizes GROUP BY variant""",
)
def catalog_metadata(spark, folder):
    path = scratch_path(spark, "catalog-metadata")
    stratify.catalog_metadata(_catalog(spark, folder)).write.json(path)
    return spark.read.schema(
        "variant string, type string, size long, num_strata long, strata_sizes string"
    ).json(path)


@query(
    "encode_fixed",
    f"""WITH {DOCS}, occ AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM docs),
    vocab AS (
      SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS token
      FROM (SELECT word, count(*) AS n FROM occ GROUP BY word) ORDER BY n DESC, word LIMIT 50257),
    enc AS (
      SELECT doc_id, list(coalesce(token, 1) ORDER BY pos) AS ids
      FROM occ LEFT JOIN vocab USING (word) WHERE pos <= 512 GROUP BY doc_id)
    SELECT doc_id, len(ids) AS n_tokens, 512 AS length,
      list_sum(ids)::BIGINT AS id_sum, md5(array_to_string(ids, ' ')) AS id_hash FROM enc""",
)
def encode_fixed(spark, folder):
    docs = documents(spark, folder)
    encoded = encode.encode_fixed(docs, encode.vocabulary(docs))
    n = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    ids = F.slice("labels", F.lit(1), n)
    return encoded.select(
        "doc_id",
        n.cast("long").alias("n_tokens"),
        F.size("input_ids").alias("length"),
        F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
        F.md5(F.array_join(F.transform(ids, lambda v: v.cast("string")), " ")).alias("id_hash"),
    )


# --- text scores ----------------------------------------------------------------------


@query("text_quality", f"WITH {SCORED} SELECT doc_id, round(quality, 6) AS quality FROM scored")
def text_quality(spark, folder):
    docs = T.with_words(documents(spark, folder))
    return docs.select("doc_id", F.round(T.quality(F.col("text"), F.col("words")), 6).alias("quality"))


@query("text_complexity", f"WITH {SCORED} SELECT doc_id, round(complexity, 6) AS complexity FROM scored")
def text_complexity(spark, folder):
    docs = T.with_words(documents(spark, folder))
    return docs.select("doc_id", F.round(T.complexity(F.col("text"), F.col("words")), 6).alias("complexity"))


ENTROPY = """
freq AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM docs) GROUP BY ALL),
ent AS (
  SELECT doc_id, -sum((c::DOUBLE / n) * ln(c::DOUBLE / n + 1e-8)) AS h
  FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS n FROM freq) GROUP BY doc_id)
"""


@query("word_entropy", f"WITH {DOCS}, {ENTROPY} SELECT doc_id, round(h, 6) AS entropy FROM ent")
def word_entropy(spark, folder):
    docs = T.with_words(documents(spark, folder))
    return docs.select("doc_id", F.round(T.word_entropy(F.col("words")), 6).alias("entropy"))


@query(
    "text_quality_rci",
    f"""WITH {DOCS}, {ENTROPY}, parts AS (
      SELECT doc_id, least((n_words::DOUBLE / len(string_split(text, '.'))) / 20, 1.0::DOUBLE) AS r,
        n_uniq::DOUBLE / greatest(n_words, 1) AS c, least(h / 10, 1.0::DOUBLE) AS i
      FROM measured JOIN ent USING (doc_id))
    SELECT doc_id, round(r, 6) AS readability, round(c, 6) AS coherence, round(i, 6) AS informativeness,
      round(0.3::DOUBLE * r + 0.3::DOUBLE * c + 0.4::DOUBLE * i, 6) AS score FROM parts""",
)
def text_quality_rci(spark, folder):
    docs = T.with_words(documents(spark, folder))
    parts = T.quality_rci(F.col("text"), F.col("words"))
    return docs.select("doc_id", *[F.round(c, 6).alias(n) for n, c in parts.items()])


_DOMAIN = ", ".join(
    f"round(({_keywords(v)})::DOUBLE / {len(v)}, 6) AS {k}" for k, v in T.DOMAIN_KEYWORDS.items()
)


@query("domain_relevance", f"WITH {DOCS} SELECT doc_id, {_DOMAIN}, 0.0::DOUBLE AS cooking FROM docs")
def domain_relevance(spark, folder):
    docs = documents(spark, folder)
    scored = docs.select("doc_id", T.domain_scores(F.col("text")).alias("s"))
    at = lambda d: F.round(F.coalesce(F.try_element_at("s", F.lit(d)), F.lit(0.0)), 6).alias(d)
    return scored.select("doc_id", *[at(d) for d in (*T.DOMAIN_KEYWORDS, "cooking")])


@query("topic_keyword", f"WITH {DOCS} SELECT doc_id, {TOPIC} AS topic FROM docs")
def topic_keyword(spark, folder):
    return documents(spark, folder).select("doc_id", T.topic(F.col("text")).alias("topic"))


def _curriculum_sql(p: float) -> str:
    if p < 0.3:
        score = "1.0::DOUBLE - n_words::DOUBLE / 200"
    elif p < 0.7:
        score = "1.0::DOUBLE - abs(n_words::DOUBLE - 300) / 300"
    else:
        score = "least(n_words::DOUBLE / 500, 1.0::DOUBLE)"
    return f"round(greatest({score}, 0.0::DOUBLE), 6)"


@query(
    "curriculum_score",
    f"""WITH {DOCS} SELECT doc_id, {_curriculum_sql(0.0)} AS early, {_curriculum_sql(0.5)} AS middle,
    {_curriculum_sql(0.9)} AS late FROM measured""",
)
def curriculum_score(spark, folder):
    n = F.col("n_words")
    return documents(spark, folder).select(
        "doc_id",
        *[F.round(T.curriculum(n, p), 6).alias(a) for a, p in (("early", 0.0), ("middle", 0.5), ("late", 0.9))],
    )


@query(
    "difficulty_level",
    f"""WITH {DOCS} SELECT doc_id,
    CASE WHEN n_words < 100 THEN 'easy' WHEN n_words < 300 THEN 'medium' ELSE 'hard' END AS level FROM measured""",
)
def difficulty_level(spark, folder):
    return documents(spark, folder).select("doc_id", T.difficulty_level(F.col("n_words")).alias("level"))


GRAMS = """
grams AS (
  SELECT doc_id, gram, count(*) AS times FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1),
      lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM docs)
  GROUP BY ALL)
"""
NOVELTY = """
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_grams, coalesce(o, 0)::BIGINT AS overlap,
  round(CASE WHEN n IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE - least(o::DOUBLE / n, 1.0::DOUBLE) END, 6) AS novelty
FROM docs LEFT JOIN (
  SELECT doc_id, sum(times) AS n, sum(times * seen) AS o FROM matched GROUP BY doc_id) USING (doc_id)
"""


@query(
    "ngram_novelty",
    rf"""WITH {DOCS}, {GRAMS},
    bench AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM benchmark),
    seen AS (SELECT gram, count(*) AS seen FROM (
      SELECT unnest(list_transform(range(1, len(ws) - 1),
        lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram FROM bench) GROUP BY gram),
    matched AS (SELECT doc_id, times, coalesce(seen, 0) AS seen FROM grams LEFT JOIN seen USING (gram))
    {NOVELTY}""",
)
def ngram_novelty(spark, folder):
    """Against the n-grams of the benchmark texts."""
    seen = novelty.seen_ngrams(table(spark, folder, "benchmark"), "item_id")
    scored = novelty.ngram_novelty(documents(spark, folder), seen)
    return scored.withColumn("novelty", F.round("novelty", 6))


@query(
    "ngram_novelty_ordered",
    f"""WITH {DOCS}, {GRAMS}, matched AS (
      SELECT doc_id, times, coalesce(sum(times) OVER (
        PARTITION BY gram ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM grams)
    {NOVELTY}""",
)
def ngram_novelty_ordered(spark, folder):
    scored = novelty.ngram_novelty_ordered(documents(spark, folder))
    return scored.withColumn("novelty", F.round("novelty", 6))


UNIGRAM = """
freq AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS word FROM docs) GROUP BY ALL),
vocab AS (SELECT word, sum(c) AS t FROM freq GROUP BY word),
total AS (SELECT sum(t) + count(*) AS size FROM vocab),
lm AS (
  SELECT doc_id, sum(c)::BIGINT AS n_words, sum(c * -ln((t + 1)::DOUBLE / size)) / sum(c) AS loss
  FROM freq JOIN vocab USING (word), total GROUP BY doc_id)
"""


@query(
    "perplexity",
    f"WITH {DOCS}, {UNIGRAM} SELECT doc_id, n_words, round(loss, 6) AS loss, round(exp(loss), 4) AS perplexity FROM lm",
)
def perplexity(spark, folder):
    lm = novelty.unigram_perplexity(documents(spark, folder))
    return lm.select("doc_id", "n_words", F.round("loss", 6).alias("loss"), F.round("perplexity", 4).alias("perplexity"))


@query(
    "perplexity_capped",
    f"""WITH {DOCS}, {UNIGRAM}, r AS (
      SELECT doc_id, exp(loss) AS p, row_number() OVER (ORDER BY doc_id) - 1 AS chosen FROM lm)
    SELECT doc_id, round(least(p / 100, 10.0::DOUBLE) / (1 + 0.05::DOUBLE * (doc_id % 50)), 6) AS score FROM r""",
)
def perplexity_capped(spark, folder):
    """With doc_id mod 50 as the number of samples chosen before."""
    lm = novelty.unigram_perplexity(documents(spark, folder))
    score = T.capped_perplexity(F.col("perplexity"), F.col("doc_id") % 50)
    return lm.select("doc_id", F.round(score, 6).alias("score"))


@query(
    "diminishing",
    f"""WITH {DOCS} SELECT doc_id, round(1 / (1 + 0.01::DOUBLE * n_words), 6) AS slow,
    round(1 / (1 + 0.05::DOUBLE * n_words), 6) AS medium, round(1 / (1 + 0.1::DOUBLE * n_words), 6) AS fast FROM measured""",
)
def diminishing(spark, folder):
    """With the word count as the size of the selected set."""
    n = F.col("n_words")
    rates = {"slow": 0.01, "medium": 0.05, "fast": 0.1}
    return documents(spark, folder).select(
        "doc_id", *[F.round(T.diminishing(n, r), 6).alias(a) for a, r in rates.items()]
    )


@query(
    "vocab_coverage",
    f"""WITH {DOCS}, occ AS (SELECT lang, unnest(ws) AS word FROM docs)
    SELECT lang, count(DISTINCT word) AS seen, round(count(DISTINCT word)::DOUBLE / (SELECT count(DISTINCT word) FROM occ), 6) AS coverage
    FROM occ GROUP BY lang""",
)
def vocab_coverage(spark, folder):
    """Share of the corpus vocabulary that the texts of a language use."""
    words = documents(spark, folder).select("lang", F.explode(T.words_of(F.col("text"))).alias("word"))
    pairs = materialise(words.distinct())
    size = pairs.select("word").distinct().agg(F.count("*")).scalar()
    return pairs.groupBy("lang").agg(F.count("*").alias("seen")).withColumn(
        "coverage", F.round(F.col("seen") / size, 6)
    )


@query(
    "vocab_coverage_rounds",
    f"""WITH {DOCS}, occ AS (SELECT doc_id % 8 AS round, unnest(ws) AS word FROM docs),
    first AS (SELECT word, min(round) AS round FROM occ GROUP BY word),
    n AS (SELECT round, count(*) AS fresh FROM first GROUP BY round)
    SELECT round, sum(fresh) OVER (ORDER BY round)::BIGINT AS seen, true AS close FROM n""",
)
def vocab_coverage_rounds(spark, folder):
    """Distinct words up to each of eight selection rounds, exactly, and whether merged sketches come within two percent of it."""
    words = documents(spark, folder).select((F.col("doc_id") % 8).alias("round"), F.explode(T.words_of(F.col("text"))).alias("word"))
    pairs = materialise(words.distinct())
    fresh = pairs.groupBy("word").agg(F.min("round").alias("round")).groupBy("round").agg(F.count("*").alias("fresh"))
    exact = fresh.select("round", F.sum("fresh").over(Window.orderBy("round")).alias("seen"))
    near = metrics.coverage_by_round(pairs, "round", "word").select("round", F.col("seen").alias("about"))
    both = exact.join(near, "round")
    return both.select("round", "seen", (F.abs(F.col("about") - F.col("seen")) <= 0.02 * F.col("seen")).alias("close"))


@query("topic_lda", f"WITH {DOCS} SELECT doc_id, 5 AS topics, true AS assigned, true AS leads FROM docs")
def topic_lda(spark, folder):
    """Topics differ between solvers, their form does not: each text has one of five, which no other one exceeds."""
    from gleaner.operators.topics import lda_topics

    found = lda_topics(documents(spark, folder), k=5)
    return found.select(
        "doc_id", F.size("shares").alias("topics"), F.col("topic").between(0, 4).alias("assigned"),
        (F.get("shares", F.col("topic")) == F.array_max("shares")).alias("leads"),
    )


# --- strata and samples ---------------------------------------------------------------


@query(
    "stratify_score_bins",
    f"WITH {SCORED} SELECT doc_id, {QUALITY_BIN} AS quality_bin, {COMPLEXITY_BIN} AS complexity_bin FROM scored",
)
def stratify_score_bins(spark, folder):
    return scored_documents(spark, folder).select(
        "doc_id",
        stratify.score_bin(F.col("quality"), 10).alias("quality_bin"),
        stratify.score_bin(F.col("complexity"), 5).alias("complexity_bin"),
    )


@query("stratify_length_named", f"WITH {DOCS} SELECT doc_id, {BAND} AS stratum FROM measured")
def stratify_length_named(spark, folder):
    return documents(spark, folder).select("doc_id", T.length_band(F.col("n_words")).alias("stratum"))


@query(
    "stratify_length_quantile",
    f"""WITH {DOCS}, e AS (
      SELECT quantile_cont(n_words, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM measured)
    SELECT doc_id, n_words, CASE WHEN n_words >= q[1] AND n_words < q[2] THEN 0 WHEN n_words >= q[2] AND n_words < q[3] THEN 1
      WHEN n_words >= q[3] AND n_words < q[4] THEN 2 WHEN n_words >= q[4] AND n_words < q[5] THEN 3 END AS stratum,
      CASE WHEN n_words = q[5] THEN 3 WHEN n_words >= q[4] THEN 3 WHEN n_words >= q[3] THEN 2 WHEN n_words >= q[2] THEN 1 ELSE 0 END AS closed
    FROM measured, e""",
)
def stratify_length_quantile(spark, folder):
    lengths = materialise(documents(spark, folder).select("doc_id", "n_words"))
    half_open = stratify.quantile_bin(lengths, "n_words", 4)
    return stratify.quantile_bin(half_open, "n_words", 4, out="closed", include_max=True)


@query("stratify_topic", f"WITH {DOCS} SELECT {TOPIC} AS stratum, count(*) AS size FROM docs GROUP BY 1")
def stratify_topic(spark, folder):
    return documents(spark, folder).groupBy(T.topic(F.col("text")).alias("stratum")).agg(F.count("*").alias("size"))


@query(
    "stratum_stats",
    f"""WITH {SCORED}, s AS (SELECT {QUALITY_BIN}::VARCHAR AS stratum, count(*) AS size FROM scored GROUP BY 1)
    SELECT 'quality' AS type, stratum, size, count(*) OVER () AS num_strata, (sum(size) OVER ())::BIGINT AS total_samples, false AS balanced FROM s""",
)
def stratum_stats(spark, folder):
    binned = _scores(spark, folder).withColumn("stratum", stratify.score_bin(F.col("quality"), 10))
    return stratify.stratum_stats(binned, "quality")


BALANCED = """
placed AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || doc_id), doc_id) AS rn,
    count(*) OVER (PARTITION BY stratum) AS size FROM strata),
kept AS (SELECT * FROM placed QUALIFY rn <= min(size) OVER ())
"""


@query(
    "balanced_quality",
    f"""WITH {SCORED}, strata AS (SELECT doc_id, quality, {QUALITY_BIN} AS stratum FROM scored), {BALANCED}
    SELECT doc_id, stratum, round(quality, 6) AS quality FROM kept""",
)
def balanced_quality(spark, folder):
    scored = _scores(spark, folder).select("doc_id", "quality", stratify.score_bin(F.col("quality"), 10).alias("stratum"))
    chosen = stratify.balanced_sample(scored, "stratum", "doc_id", seed=7)
    return chosen.select("doc_id", "stratum", F.round("quality", 6).alias("quality"))


@query(
    "balanced_sample",
    f"""WITH {DOCS}, strata AS (SELECT doc_id, lang AS stratum FROM docs), {BALANCED}
    SELECT doc_id, stratum FROM kept""",
)
def balanced_sample(spark, folder):
    """The same number of documents per language."""
    docs = documents(spark, folder).select("doc_id", F.col("lang").alias("stratum"))
    return stratify.balanced_sample(docs, "stratum", "doc_id", seed=7)


@query(
    "balanced_sample_capped",
    f"""WITH {DOCS}, strata AS (SELECT doc_id, lang AS stratum FROM docs), {BALANCED}
    SELECT doc_id, stratum FROM placed WHERE rn <= 60""",
)
def balanced_sample_capped(spark, folder):
    """At most 60 documents per language."""
    docs = documents(spark, folder).select("doc_id", F.col("lang").alias("stratum"))
    return stratify.balanced_sample(docs, "stratum", "doc_id", seed=7, cap_per_stratum=60)


# --- selection ------------------------------------------------------------------------


@query(
    "topk_score",
    f"WITH {SCORED} SELECT doc_id, round(complexity, 6) AS complexity FROM scored ORDER BY scored.complexity DESC, doc_id LIMIT 100",
)
def topk_score(spark, folder):
    scored = scored_documents(spark, folder).select("doc_id", "complexity")
    return select.top_k(scored, "complexity", "doc_id", 100).withColumn("complexity", F.round("complexity", 6))


@query(
    "budget_ratio",
    f"""WITH {SCORED} SELECT doc_id FROM scored
    QUALIFY row_number() OVER (ORDER BY quality DESC, doc_id) <= floor(count(*) OVER () * 0.1::DOUBLE)""",
)
def budget_ratio(spark, folder):
    scores = _scores(spark, folder).select("doc_id", "quality")
    return select.top_ratio(scores, "quality", "doc_id", 0.1).select("doc_id")


@query(
    "domain_prefilter_topk",
    f"""WITH {SCORED}, pool AS (
      SELECT *, ({_keywords(T.DOMAIN_KEYWORDS["code"])})::DOUBLE / 8 AS d FROM scored ORDER BY d DESC, doc_id LIMIT 250)
    SELECT doc_id, round(quality, 6) AS quality FROM pool ORDER BY pool.quality DESC, doc_id LIMIT 50""",
)
def domain_prefilter_topk(spark, folder):
    pool = select.domain_pool(documents(spark, folder), "code", "doc_id", 50)
    scored = text_metadata(pool).select("doc_id", "quality")
    return select.top_k(scored, "quality", "doc_id", 50).withColumn("quality", F.round("quality", 6))


@query(
    "pool_then_topk",
    f"""WITH {SCORED}, pool AS (SELECT * FROM scored ORDER BY md5('3:' || doc_id), doc_id LIMIT 200)
    SELECT doc_id, round(complexity, 6) AS complexity FROM pool ORDER BY pool.complexity DESC, doc_id LIMIT 40""",
)
def pool_then_topk(spark, folder):
    """The pool is drawn before scoring, so only its texts are scored."""
    pool = select.random_pool(documents(spark, folder), "doc_id", 200, seed=3)
    scored = text_metadata(pool).select("doc_id", "complexity")
    return select.top_k(scored, "complexity", "doc_id", 40).withColumn("complexity", F.round("complexity", 6))


@query("random_select", f"WITH {DOCS} SELECT doc_id FROM docs ORDER BY md5('11:' || doc_id), doc_id LIMIT 100")
def random_select(spark, folder):
    return select.random_select(documents(spark, folder).select("doc_id"), "doc_id", 100, seed=11)


@query(
    "coreset_apply",
    f"""WITH {DOCS}, chosen AS (SELECT doc_id FROM docs ORDER BY md5('11:' || doc_id), doc_id LIMIT 100)
    SELECT doc_id, n_words FROM measured SEMI JOIN chosen USING (doc_id)""",
)
def coreset_apply(spark, folder):
    docs = documents(spark, folder).select("doc_id", "n_words")
    return select.keep_selected(docs, random_select(spark, folder), "doc_id")


@query(
    "exclude_selected",
    f"""WITH {DOCS}, chosen AS (SELECT doc_id FROM docs ORDER BY md5('11:' || doc_id), doc_id LIMIT 100)
    SELECT doc_id, n_words FROM measured ANTI JOIN chosen USING (doc_id)""",
)
def exclude_selected(spark, folder):
    docs = documents(spark, folder).select("doc_id", "n_words")
    return select.exclude_selected(docs, random_select(spark, folder), "doc_id")


# --- distributions ----------------------------------------------------------------------


@query(
    "selection_entropy_hist",
    f"""WITH {DOCS}, chosen AS (SELECT doc_id FROM docs ORDER BY md5('11:' || doc_id), doc_id LIMIT 100),
    b AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM chosen),
    h AS (SELECT least(floor((doc_id - lo)::DOUBLE / (hi - lo) * 10), 9) AS bin, count(*) AS n FROM chosen, b GROUP BY 1)
    SELECT round(-sum((n / 100) * ln(n / 100 + 1e-8)), 6) AS entropy FROM h""",
)
def selection_entropy_hist(spark, folder):
    return metrics.histogram_entropy(random_select(spark, folder), "doc_id").select(F.round("entropy", 6).alias("entropy"))


@query(
    "class_distribution",
    f"""WITH {DOCS}, c AS (SELECT lang, {BAND} AS band FROM measured)
    SELECT 'lang' AS kind, lang AS class, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY lang
    UNION ALL SELECT 'length', band, count(*), round(count(*) / (SELECT count(*) FROM c), 6) FROM c GROUP BY band""",
)
def class_distribution(spark, folder):
    docs = materialise(documents(spark, folder).select("lang", T.length_band(F.col("n_words")).alias("band")))
    parts = {"lang": "lang", "length": "band"}
    each = [metrics.class_distribution(docs, c).withColumn("kind", F.lit(k)) for k, c in parts.items()]
    return each[0].unionByName(each[1]).withColumn("share", F.round("share", 6))


@query(
    "selection_mod_bins",
    f"""WITH {DOCS}, chosen AS (SELECT doc_id FROM docs ORDER BY md5('11:' || doc_id), doc_id LIMIT 100)
    SELECT doc_id % 10 AS bin, count(*) AS n FROM chosen GROUP BY 1""",
)
def selection_mod_bins(spark, folder):
    return metrics.mod_bins(random_select(spark, folder), "doc_id")


# --- duplicates -----------------------------------------------------------------------


@query(
    "exact_dedup",
    f"WITH {DOCS} SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM docs GROUP BY text",
)
def exact_dedup(spark, folder):
    return dedup.first_occurrences(documents(spark, folder), F.col("text"), "doc_id")


@query(
    "bloom_dedup",
    f"""WITH {DOCS}, seen AS (SELECT DISTINCT text FROM docs WHERE lang = 'en')
    SELECT md5(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM docs
    WHERE lang <> 'en' AND text NOT IN (SELECT text FROM seen) GROUP BY text""",
)
def bloom_dedup(spark, folder):
    """New texts among the other languages, against all English ones: membership is exact, so no new text is lost."""
    docs = documents(spark, folder)
    return dedup.new_texts(docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"), F.col("text"), "doc_id")
