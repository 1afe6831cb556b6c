"""Queries on model signals and vectors, over `embeddings`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import signals as S
from gleaner.functions import text as T
from gleaner.functions import vectors as V
from gleaner.operators import combine, dedup, greedy, lowrank, metrics, neighbours, novelty, select, signals
from gleaner.plans.base import query
from gleaner.plans.history import EV, MEMORY, memory
from gleaner.plans.corpus import SCORED, _keywords, documents, scored_documents
from gleaner.registry import ScorerRegistry, Scorer, select_with, signal_scorers
from gleaner.session import materialise
from gleaner.sources.tables import spread, table

# SQL fragments: `e` (id, x, label), `sig` (id, x, label, p, y, loss).
E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
SIG = f"""
{E},
cent AS (
  SELECT label AS k, list(m ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM e)
    GROUP BY label, pos) GROUP BY label),
classes AS (SELECT list(k ORDER BY k) AS ks, list(c ORDER BY k) AS cs FROM cent),
expd AS (SELECT id, k, exp(-(list_distance(x, c) ^ 2)) AS v FROM e, cent),
probs AS (SELECT id, list(v / t ORDER BY k) AS p FROM (SELECT *, sum(v) OVER (PARTITION BY id) AS t FROM expd) GROUP BY id),
sig AS (
  SELECT id, x, label, p, list_position(ks, label) - 1 AS y, -ln(p[list_position(ks, label)]) AS loss,
    list_transform(p, lambda v, i: v - (i = list_position(ks, label))::INT) AS err, ks, cs
  FROM e JOIN probs USING (id), classes)
"""
NORM_E = "sqrt(list_dot_product(err, err))"
NORM_X = "sqrt(list_dot_product(x, x))"
ENTROPY = "-list_sum(list_transform(p, lambda v: v * ln(v + 1e-8)))"


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    df = spread(table(spark, folder, "embeddings"), "vec_id")
    return df.select(F.col("vec_id").alias("id"), V.as_double(F.col("embedding")).alias("x"), "label")


def signal_table(spark: SparkSession, folder: str) -> DataFrame:
    return signals.centroid_signals(vectors(spark, folder))


def P():
    return F.col("p")


def Y():
    return F.col("y")


def X():
    return F.col("x")


def _score(name: str, column, sql: str, digits: int = 6):
    @query(name, f"WITH {SIG} SELECT id, round({sql}, {digits}) AS score FROM sig")
    def run(spark, folder):
        return signal_table(spark, folder).select("id", F.round(column(), digits).alias("score"))

    return run


# --- providers and row-level scores ---------------------------------------------------


@query(
    "signal_centroid",
    f"""WITH {SIG} SELECT id, y, round(loss, 6) AS loss, round(list_max(p), 6) AS top,
    round(p[1], 6) AS first, round(list_sum(p), 6) AS total FROM sig""",
)
def signal_centroid(spark, folder):
    """The softmax over all class centroids, class blocks at a time."""
    found = signals.class_softmax(vectors(spark, folder))
    return _rounded(found, ["loss", "top", "first", "total"])


def _rounded(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "signal_logreg",
    "SELECT vec_id AS id, label::BIGINT AS y, 10 AS classes, 1.0::DOUBLE AS total, true AS consistent FROM embeddings",
)
def signal_logreg(spark, folder):
    """The fit differs between solvers, its form does not: proper probabilities, and a loss that is the label's."""
    scored = signals.logistic_signals(vectors(spark, folder))
    own = F.get("p", F.col("y"))
    return scored.select(
        "id", F.col("y").cast("long").alias("y"), F.size("p").alias("classes"), F.round(V.total(P()), 6).alias("total"),
        (F.abs(F.col("loss") + F.log(own)) < 1e-6).alias("consistent"),
    )


_score("entropy_uncertainty", lambda: S.uncertainty(P()), ENTROPY)
_score(
    "boundary", lambda: S.boundary(P()),
    "exp(-5.0::DOUBLE * (list_reverse_sort(p)[1] - list_reverse_sort(p)[2]))",
)
_score("confidence_difficulty", lambda: S.confidence_difficulty(P()), "1.0::DOUBLE - list_max(p)")
_score("grad_magnitude", lambda: S.grad_magnitude(P(), Y(), X()), f"{NORM_E} * {NORM_X}")
_score("grad_norm_sum", lambda: S.grad_norm_sum(P(), Y(), X()), f"{NORM_E} * {NORM_X} + {NORM_E}")
_score("influence", lambda: S.influence(P(), Y(), X()), f"({NORM_E} * {NORM_X}) ^ 2")
_score(
    "hybrid_score", lambda: S.hybrid(P(), Y(), X()),
    f"0.5::DOUBLE * ({NORM_E} * {NORM_X} + {NORM_E}) + 0.5::DOUBLE * ({ENTROPY})",
)
_score(
    "input_gradient", lambda: S.input_gradient(P(), Y(), F.col("centroids")),
    """2 * sqrt(list_sum(list_transform(range(1, len(x) + 1), lambda j:
      (list_sum(list_transform(range(1, len(p) + 1), lambda i: err[i] * cs[i][j]))) ^ 2)))""",
)


@query(
    "ensemble_table_uncertainty",
    """WITH m AS (SELECT user_id AS id, event_id AS member, 1 / (1 + exp(-value / 50)) AS q FROM events),
    c AS (SELECT id, var_samp(q) AS a, var_samp(1 - q) AS b FROM m GROUP BY id)
    SELECT id, round((coalesce(a, 0) + coalesce(b, 0)) / 2, 9) AS uncertainty FROM c""",
)
def ensemble_table_uncertainty(spark, folder):
    """A user's events as the members of its ensemble, each with two class probabilities."""
    q = 1 / (1 + F.exp(-F.col("value") / 50))
    members = table(spark, folder, "events").select(F.col("user_id").alias("id"), F.array(q, 1 - q).alias("probs"))
    return signals.ensemble_uncertainty(members, "id").withColumn("uncertainty", F.round("uncertainty", 9))


@query("knn_near", "SELECT count(*) AS n, count(*) * 5 AS pairs, true AS distances_are_exact, true AS finds_nine_of_ten FROM embeddings")
def knn_near(spark, folder):
    """The five near vectors of each vector from the buckets, against the exact ones."""
    df = vectors(spark, folder)
    found = materialise(neighbours.knn_near(df, df, 5, exclude_self=True, unit=True))
    exact = neighbours.knn(df, df, 5, exclude_self=True, unit=True)
    names = [c for c in exact.columns if c not in ("rank", "distance")]
    both = exact.join(found.select(*names, F.col("distance").alias("near")), names, "left")
    share = F.count("near") / F.count("*")
    gap = F.max(F.abs(F.col("near") - F.col("distance")))
    facts = both.agg((share >= 0.9).alias("finds_nine_of_ten"), (F.coalesce(gap, F.lit(1.0)) < 1e-9).alias("distances_are_exact"))
    return facts.select(
        df.agg(F.count("*")).scalar().alias("n"), found.agg(F.count("*")).scalar().alias("pairs"), "distances_are_exact", "finds_nine_of_ten"
    )


@query(
    "ensemble_uncertainty",
    f"""WITH {SIG}, members AS (
      SELECT id, m, c, exp(ln(p[c]) * (1 + 0.1::DOUBLE * m)) AS v
      FROM sig, (SELECT unnest(range(0, 5)) AS m), (SELECT unnest(range(1, 11)) AS c)),
    soft AS (SELECT id, m, c, v / sum(v) OVER (PARTITION BY id, m) AS q FROM members)
    SELECT id, round(avg(s), 9) AS uncertainty FROM (
      SELECT id, c, var_samp(q) AS s FROM soft GROUP BY id, c) GROUP BY id""",
)
def ensemble_uncertainty(spark, folder):
    """Five members: the probabilities at inverse temperatures 1.0 to 1.4.

    The members of a sample are one array, so the variance needs no shuffle.
    """
    members = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda m: S.softmax(F.transform("p", lambda v: F.log(v) * (1 + 0.1 * m))),
    )

    def spread(ms):
        series = lambda c: F.transform(ms, lambda q: F.get(q, c))
        each = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda c: V.let(series(c), V.pop_variance))
        return V.mean(each) * 5 / 4

    return signal_table(spark, folder).select("id", F.round(V.let(members, spread), 9).alias("uncertainty"))


@query(
    "grad_alignment",
    f"""WITH {SIG}, g AS (
      SELECT i, j, avg(err[i] * x[j]) AS m FROM sig, (SELECT unnest(range(1, 11)) AS i), (SELECT unnest(range(1, 65)) AS j) GROUP BY i, j),
    b AS (SELECT i, avg(err[i]) AS m FROM sig, (SELECT unnest(range(1, 11)) AS i) GROUP BY i),
    gn AS (SELECT sqrt(sum(m * m)) AS n FROM g), bn AS (SELECT sqrt(sum(m * m)) AS n FROM b),
    gd AS (SELECT id, sum(err[i] * x[j] * m) AS d FROM sig, g GROUP BY id),
    bd AS (SELECT id, sum(err[i] * m) AS d FROM sig, b GROUP BY id)
    SELECT id, round(((gd.d / (greatest({NORM_E} * {NORM_X}, 1e-8) * greatest(gn.n, 1e-8))
      + bd.d / (greatest({NORM_E}, 1e-8) * greatest(bn.n, 1e-8))) / 2 + 1) / 2, 6) AS alignment
    FROM sig JOIN gd USING (id) JOIN bd USING (id), gn, bn""",
)
def grad_alignment(spark, folder):
    staged = materialise(signal_table(spark, folder).select("id", "x", "p", "y"))
    return _rounded(signals.grad_alignment(staged), ["alignment"])


@query(
    "token_importance",
    "SELECT user_id AS id, round(least(avg(value / 10) / 10, 1.0::DOUBLE), 6) AS importance FROM events GROUP BY user_id",
)
def token_importance(spark, folder):
    """A tenth of each event value as a token gradient norm of its user."""
    norms = table(spark, folder, "events").select(F.col("user_id").alias("id"), (F.col("value") / 10).alias("value"))
    return novelty.token_importance(norms, "id", "value").withColumn("importance", F.round("importance", 6))


@query(
    "attention_coverage",
    """WITH w AS (SELECT user_id AS id, exp(value / 500) AS v FROM events),
    p AS (SELECT id, v / sum(v) OVER (PARTITION BY id) AS p, count(*) OVER (PARTITION BY id) AS n FROM w)
    SELECT id, round(CASE WHEN max(n) > 1 THEN -sum(p * ln(p + 1e-8)) / ln(max(n)) ELSE 0 END, 6) AS coverage FROM p GROUP BY id""",
)
def attention_coverage(spark, folder):
    """Event values scaled to [0, 1] as attention weights of their user."""
    weights = table(spark, folder, "events").select(F.col("user_id").alias("id"), (F.col("value") / 500).alias("w"))
    return novelty.attention_coverage(weights, "id", "w").withColumn("coverage", F.round("coverage", 6))


@query(
    "eval_accuracy_loss",
    f"""WITH {SIG}, b AS (SELECT avg(m) AS bm, count(*) AS nb FROM (SELECT avg(loss) AS m FROM sig GROUP BY id // 128))
    SELECT round(100 * avg((list_position(p, list_max(p)) - 1 = y)::INT), 6) AS accuracy, round(avg(loss), 6) AS avg_loss,
      round(any_value(bm), 6) AS batch_mean_loss, any_value(nb) AS batches FROM sig, b""",
)
def eval_accuracy_loss(spark, folder):
    """Vector ids are positions, so id / 128 is the batch."""
    staged = materialise(signal_table(spark, folder).select("id", "p", "y", "loss"))
    whole, batches = metrics.accuracy_loss(staged), metrics.batch_mean_loss(staged, "id", "loss")
    b = batches.select(F.struct("batch_mean_loss", "batches")).scalar()
    return whole.select(
        F.round("accuracy", 6).alias("accuracy"), F.round("avg_loss", 6).alias("avg_loss"), b.alias("b")
    ).select(
        "accuracy", "avg_loss", F.round("b.batch_mean_loss", 6).alias("batch_mean_loss"), F.col("b.batches").alias("batches")
    )


@query(
    "lm_eval",
    """WITH t AS (
      SELECT (n_chars % 100) / 25 AS loss, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n
      FROM documents)
    SELECT round(avg(loss), 6) AS loss, round(exp(avg(loss)), 6) AS perplexity, round(sum(n) / count(*), 6) AS tokens_per_sample FROM t""",
)
def lm_eval(spark, folder):
    """All documents, with a loss derived from their length."""
    docs = table(spark, folder, "documents")
    losses = docs.select((F.col("n_chars") % 100 / 25).alias("loss"), F.size(_words()).alias("n"))
    found = metrics.language_eval(losses, "loss", "n")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


def _words():
    from gleaner.functions.text import words_of

    return words_of(F.col("text"))


# --- distances --------------------------------------------------------------------------


CHOSEN = "chosen AS (SELECT * FROM e ORDER BY md5('5:' || id), id LIMIT 20)"


def _chosen(df: DataFrame) -> DataFrame:
    return select.random_select(df, "id", 20, seed=5)


@query(
    "min_dist_euclid",
    f"""WITH {E}, {CHOSEN} SELECT e.id, round(min(list_distance(e.x, c.x)) / sqrt(64), 6) AS score
    FROM e, chosen c GROUP BY e.id""",
)
def min_dist_euclid(spark, folder):
    """To 20 random vectors, over the root of the dimension."""
    df = vectors(spark, folder)
    near = neighbours.min_distance(df, _chosen(df))
    score = F.coalesce(F.col("min_distance") / F.sqrt(F.size("x")), F.lit(1.0))
    return near.select("id", F.round(score, 6).alias("score"))


@query(
    "min_dist_cosine",
    f"""WITH {E}, {CHOSEN} SELECT e.id, round(min(1 - list_cosine_similarity(e.x, c.x)), 6) AS score
    FROM e, chosen c GROUP BY e.id""",
)
def min_dist_cosine(spark, folder):
    """On unit vectors 1 - cosine is half the squared distance."""
    df = vectors(spark, folder)
    near = neighbours.min_distance(df, _chosen(df), unit=True)
    score = F.coalesce(F.pow("min_distance", F.lit(2.0)) / 2, F.lit(1.0))
    return near.select("id", F.round(score, 6).alias("score"))


@query(
    "min_dist_recent",
    f"""WITH {E}, recent AS (SELECT * FROM e ORDER BY id DESC LIMIT 100)
    SELECT e.id, round(least(min(list_distance(e.x, c.x)) / sqrt(64), 1.0::DOUBLE), 6) AS score
    FROM e, recent c GROUP BY e.id""",
)
def min_dist_recent(spark, folder):
    """To the last 100 vectors."""
    df = vectors(spark, folder)
    near = neighbours.min_distance(df, select.top_k(df, "id", "id", 100))
    score = F.least(F.coalesce(F.col("min_distance") / F.sqrt(F.size("x")), F.lit(1.0)), F.lit(1.0))
    return near.select("id", F.round(score, 6).alias("score"))


@query(
    "diversity_vs_history",
    f"""WITH {E}, recent AS (SELECT * FROM e ORDER BY id DESC LIMIT 1000)
    SELECT e.id, round(min(list_distance(e.x, c.x)), 6) AS score FROM e, recent c GROUP BY e.id""",
)
def diversity_vs_history(spark, folder):
    """To the last 1000 vectors."""
    df = vectors(spark, folder)
    past = select.top_k(df, "id", "id", 1000)
    near = neighbours.min_distance(df, past)
    return near.select("id", F.round(F.coalesce("min_distance", F.lit(1.0)), 6).alias("score"))


@query(
    "knn_diversity",
    f"""WITH {E}, u AS (SELECT id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x FROM e),
    d AS (SELECT a.id, list_distance(a.x, b.x) AS d FROM u a JOIN u b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS rn FROM d)
    SELECT id, round(avg(d), 6) AS diversity FROM r WHERE rn <= 5 GROUP BY id""",
)
def knn_diversity(spark, folder):
    return neighbours.knn_diversity(vectors(spark, folder)).withColumn("diversity", F.round("diversity", 6))


@query(
    "l2_normalise",
    f"""WITH {E} SELECT id, round(list_sum(list_transform(x, lambda v: v * v / list_dot_product(x, x))), 6) AS norm,
    round(x[1] / sqrt(list_dot_product(x, x)), 6) AS first, round(x[64] / sqrt(list_dot_product(x, x)), 6) AS last FROM e""",
)
def l2_normalise(spark, folder):
    unit = vectors(spark, folder).select("id", V.normalised(X()).alias("u"))
    u = F.col("u")
    return unit.select(
        "id", F.round(V.dot(u, u), 6).alias("norm"), F.round(F.get(u, F.lit(0)), 6).alias("first"),
        F.round(F.element_at(u, -1), 6).alias("last"),
    )


@query("lowrank_project", "SELECT vec_id AS id, 8 AS rank, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS energy FROM embeddings")
def lowrank_project(spark, folder):
    """Orthonormal directions split each vector's energy: that of the projection and the squared residual add up."""
    done = lowrank.project(vectors(spark, folder), "x", 8)
    energy = V.dot(F.col("projected"), F.col("projected")) + F.col("residual")
    return done.select("id", F.size("projected").alias("rank"), F.round(energy, 6).alias("energy"))


@query(
    "lowrank_facts",
    """SELECT count(*) AS n, 8 AS rank, true AS orthonormal, round(sum(list_dot_product(embedding, embedding)), 3) AS energy
    FROM embeddings""",
)
def lowrank_facts(spark, folder):
    """What holds for any orthonormal projection: its directions are, and the parts of each vector's energy add up."""
    df = vectors(spark, folder)
    directions = lowrank.principal_directions(df, "x", 8)
    orthonormal = bool(np.allclose(directions.T @ directions, np.eye(8), atol=1e-8))
    done = lowrank.project(df, "x", 8)
    energy = F.sum(V.dot(F.col("projected"), F.col("projected")) + F.col("residual"))
    return done.agg(F.count("*").alias("n"), F.max(F.size("projected")).alias("rank"), F.lit(orthonormal).alias("orthonormal"), F.round(energy, 3).alias("energy"))


@query(
    "lowrank_bound",
    """SELECT count(*) AS n, 8 AS rank, 24 AS sketch_rows, true AS within_bound, true AS not_below_best,
    round(sum(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS energy FROM embeddings""",
)
def lowrank_bound(spark, folder):
    """The published bound: the error of 8 directions from a sketch of 24 rows is at most 1 + 8 / (24 - 8) times the best one's.
    A sketch with as many rows as dimensions loses nothing, so its directions are the best ones."""
    df = vectors(spark, folder).select("x")
    shared = F.broadcast(df.sparkSession.createDataFrame([(
        lowrank.principal_directions(df, "x", 8, size=24).T.tolist(), lowrank.principal_directions(df, "x", 8, size=64).T.tolist()
    )], "sketched array<array<double>>, best array<array<double>>"))
    kept = lambda d: V.total(F.transform(d, lambda r: F.pow(V.dot(r, F.col("x")), 2)))
    whole = F.sum(V.dot(F.col("x"), F.col("x")))
    rows = df.withColumn("_d", shared.select(F.struct("sketched", "best")).scalar())
    sums = rows.agg(F.count("*").alias("n"), whole.alias("e"), F.sum(kept(F.col("_d.sketched"))).alias("s"), F.sum(kept(F.col("_d.best"))).alias("b"))
    error, best = F.col("e") - F.col("s"), F.col("e") - F.col("b")
    return sums.select(
        "n", F.lit(8).alias("rank"), F.lit(24).alias("sketch_rows"), (error <= (1 + 8 / (24 - 8)) * best).alias("within_bound"),
        (error >= best - 1e-6).alias("not_below_best"), F.round("e", 4).alias("energy"),
    )


@query(
    "lowrank_two_sided",
    """WITH m AS (SELECT label AS layer, vec_id // 128 AS step, vec_id, embedding::DOUBLE[] AS x FROM embeddings)
    SELECT layer, step::BIGINT AS step, count(*) AS n, 64 AS numbers, round(sum(list_dot_product(x, x)), 4) AS energy, true AS consistent
    FROM m GROUP BY layer, step""",
)
def lowrank_two_sided(spark, folder):
    """A matrix per label and 128 vectors, projected on both sides with factors that are renewed every fourth step.

    For any such factors <x, restored> sums to the squared size of the core, so the energy of a matrix is what its
    rows lost, plus twice the core, less what was restored.
    """
    df = vectors(spark, folder).select(
        F.col("label").alias("layer"), F.floor(F.col("id") / 128).alias("step"), (F.col("id") % 128).alias("row"), "x"
    )
    core, rows = lowrank.project_matrices(df, "layer", "step", "row", "x", 8, 4)
    joined = rows.join(df, ["layer", "step", "row"])
    parts = joined.groupBy("layer", "step").agg(
        F.count("*").alias("n"), F.sum("residual").alias("lost"), F.sum(V.dot(F.col("restored"), F.col("restored"))).alias("back"),
        F.sum(V.dot(F.col("x"), F.col("restored"))).alias("inner"),
    )
    both = parts.join(core, ["layer", "step"]).withColumn("size", V.dot(F.col("core"), F.col("core")))
    return both.select(
        "layer", "step", "n", F.size("core").alias("numbers"), F.round(F.col("lost") + 2 * F.col("size") - F.col("back"), 4).alias("energy"),
        (F.abs(F.col("inner") - F.col("size")) <= 1e-6 * (1 + F.col("size"))).alias("consistent"),
    )


@query(
    "logreg_facts",
    """SELECT count(*) AS n, sum(label)::BIGINT AS label_sum, true AS probabilities_sum_to_one, true AS beats_chance,
    true AS gradient_is_small FROM embeddings""",
)
def logreg_facts(spark, folder):
    """What holds for any fit at its optimum: proper probabilities, a loss below chance, predicted class sizes near the true ones."""
    scored = materialise(signals.logistic_signals(vectors(spark, folder), iterations=100).select("id", "y", "p", "loss"))
    sizes = scored.select("y", F.posexplode("p").alias("c", "q")).groupBy("c").agg(
        (F.abs(F.sum("q") - F.count_if(F.col("c") == F.col("y"))) / F.count("*")).alias("gap")
    )
    widest = sizes.agg(F.max("gap")).scalar()
    summed = F.abs(F.aggregate("p", F.lit(0.0), lambda a, q: a + q) - 1)
    found = scored.agg(
        F.count("*").alias("n"), F.sum("y").alias("label_sum"), (F.max(summed) < 1e-9).alias("probabilities_sum_to_one"),
        (F.avg("loss") < F.log(F.lit(10.0))).alias("beats_chance"),
    )
    # the intercept carries no penalty, so its gradient, the gap between both sizes of a class, is 0 at the optimum
    return found.withColumn("gradient_is_small", widest < 1e-3)


@query(
    "compression_ratio",
    f"WITH {E} SELECT round((count(*) + 64) * 256 / (count(*) * 64), 6) AS stored_ratio, 0.256::DOUBLE AS nominal_ratio FROM e",
)
def compression_ratio(spark, folder):
    found = lowrank.compression_ratio(vectors(spark, folder), "x", 256)
    return found.select(F.round("stored_ratio", 6).alias("stored_ratio"), "nominal_ratio")


@query(
    "score_quantise",
    """WITH b AS (SELECT least(0.0::DOUBLE, min(value)) AS lo, greatest(1.0::DOUBLE, max(value)) AS hi FROM events)
    SELECT event_id, floor((value - lo) / (hi - lo) * 65535)::INT AS quantised FROM events, b""",
)
def score_quantise(spark, folder):
    return dedup.quantise(table(spark, folder, "events").select("event_id", "value"), "value").select(
        "event_id", "quantised"
    )


# --- strategies -------------------------------------------------------------------------


@query(
    "strategy_profiles",
    f"""WITH {SIG}, {EV}, {MEMORY}, near AS (
      SELECT e.id, min(list_distance(e.x, c.x)) AS diversity FROM e, (SELECT * FROM e ORDER BY md5('5:' || id), id LIMIT 20) c GROUP BY e.id),
    s AS (SELECT id, {ENTROPY} AS u, {NORM_E} * {NORM_X} AS g, 1 - list_max(p) AS d, diversity AS v, loss AS i,
      coalesce(latest.volatility, 0) / 100 AS o, coalesce(latest.staleness, 0) / 100 AS st
      FROM sig JOIN near USING (id) LEFT JOIN latest ON latest.user_id = sig.id)
    SELECT id, 'explore' AS strategy, round(u + 0.8::DOUBLE * o + 0.3::DOUBLE * g, 6) AS score FROM s
    UNION ALL SELECT id, 'exploit', round(i + 0.7::DOUBLE * g + 0.2::DOUBLE * u, 6) FROM s
    UNION ALL SELECT id, 'refresh', round(st + 0.5::DOUBLE * v, 6) FROM s
    UNION ALL SELECT id, 'balance', round(v + 0.5::DOUBLE * u + 0.5::DOUBLE * i, 6) FROM s
    UNION ALL SELECT id, 'focus', round(d + 0.8::DOUBLE * g, 6) FROM s""",
)
def strategy_profiles(spark, folder):
    """All seven scores: a sample's memory is that of the user with its number, and the loss stands for the impact."""
    df = signal_table(spark, folder)
    latest = memory(spark, folder).groupBy(F.col("user_id").alias("id")).agg(
        F.max_by(F.struct("volatility", "staleness"), "step").alias("m")
    )
    kept = lambda c: (F.coalesce(F.col(f"m.{c}"), F.lit(0)) / 100).alias(c)
    near = neighbours.min_distance(df, _chosen(vectors(spark, folder)), out="diversity")
    scored = near.join(latest, "id", "left").select(
        "id", "diversity", S.uncertainty(P()).alias("uncertainty"), S.grad_magnitude(P(), Y(), X()).alias("gradient"),
        S.confidence_difficulty(P()).alias("difficulty"), F.col("loss").alias("impact"), kept("volatility"), kept("staleness"),
    )
    names = ["uncertainty", "gradient", "difficulty", "diversity", "impact", "volatility", "staleness"]
    found = combine.strategy_scores(scored, "id", names)
    return found.withColumn("score", F.round("score", 6))


@query(
    "weighted_combine",
    f"""WITH {SIG} SELECT id, round(0.4::DOUBLE * ({NORM_E} * {NORM_X}) + 0.35::DOUBLE * ({ENTROPY})
      + 0.25::DOUBLE * exp(-5.0::DOUBLE * (list_reverse_sort(p)[1] - list_reverse_sort(p)[2])), 6) AS score FROM sig""",
)
def weighted_combine(spark, folder):
    weights = {"grad_mag": 0.4, "uncertainty": 0.35, "boundary": 0.25}
    return signal_scorers().combine(signal_table(spark, folder), weights).select("id", F.round("score", 6).alias("score"))


@query(
    "composed_strategy",
    f"""WITH {SIG}, s AS (SELECT id, {ENTROPY} AS u, {NORM_E} * {NORM_X} AS g, list_max(p) AS m FROM sig)
    SELECT id, round(least(greatest((0.6::DOUBLE * u + 0.4::DOUBLE * g) * (0.9::DOUBLE * m), 0.5::DOUBLE * g), 0.8::DOUBLE * u), 6) AS score FROM s""",
)
def composed_strategy(spark, folder):
    u, g, m = S.uncertainty(P()), S.grad_magnitude(P(), Y(), X()), F.array_max("p")
    score = combine.composed(
        [u, g, m, g, u], ["add", "multiply", "max", "min"], [0.6, 0.4, 0.9, 0.5, 0.8]
    )
    return signal_table(spark, folder).select("id", F.round(score, 6).alias("score"))


@query(
    "strategy_dispatch",
    f"""WITH {SIG}, {CHOSEN},
    near AS (SELECT e.id, min(list_distance(e.x, c.x)) AS d FROM e, chosen c GROUP BY e.id),
    s AS (SELECT id, {ENTROPY} AS u, {NORM_E} * {NORM_X} + {NORM_E} AS g, d FROM sig JOIN near USING (id)),
    all_ AS (
      SELECT id, s, score FROM s, LATERAL (SELECT unnest(['grad_mag', 'grad_var', 'influence', 'diversity', 'uncertainty',
        'grad_conflict', 'forgetting', 'hybrid', 'weighted', 'composed']) AS s,
        unnest([g, g, g, d, u, g, u, 0.5::DOUBLE * g + 0.5::DOUBLE * u, g, g]) AS score))
    SELECT s AS strategy, id, round(score, 6) AS score FROM all_
    QUALIFY row_number() OVER (PARTITION BY s ORDER BY score DESC, id) <= 25""",
)
def strategy_dispatch(spark, folder):
    """The 25 picks of every strategy."""
    from gleaner.registry import STRATEGIES

    df = materialise(signal_table(spark, folder).select("id", "x", "p", "y"))
    chosen = _chosen(vectors(spark, folder))
    picks = None
    for name in STRATEGIES:
        one = select_with(name, df, 25, selected=chosen).select(
            F.lit(name).alias("strategy"), "id", F.round("score", 6).alias("score")
        )
        picks = one if picks is None else picks.unionByName(one)
    return picks


@query(
    "scorer_registry",
    f"""WITH {SIG} SELECT id, round({NORM_E} * {NORM_X}, 6) AS grad_mag, round(list_max(p) - list_min(p), 6) AS spread,
    round(0.5::DOUBLE * ({NORM_E} * {NORM_X}) + 0.5::DOUBLE * (list_max(p) - list_min(p)), 6) AS score FROM sig""",
)
def scorer_registry(spark, folder):
    """A scorer of the user's own next to a built-in one, picked by name."""
    registry = ScorerRegistry([Scorer("unused", (), lambda _: F.lit(0.0))])
    registry.register("spread", ["p"], lambda _: F.array_max("p") - F.array_min("p"), granularity="sample")
    for name in ("grad_mag",):
        scorer = signal_scorers()._scorers[name]
        registry.register(name, scorer.requires, scorer.fn, scorer.submodular, scorer.granularity)
    scored = registry.combine(signal_table(spark, folder), {"grad_mag": 0.5, "spread": 0.5})
    return scored.select("id", *[F.round(c, 6).alias(c) for c in ("grad_mag", "spread", "score")])


# --- greedy selection -------------------------------------------------------------------


def _greedy_sql(static: str, weight: float, rate: float, scale: float, picks: int, base: str | None = None) -> str:
    gain = f"s / (1 + {rate}::DOUBLE * t) + {weight}::DOUBLE * near"
    base = base or f"{SIG}, base AS (SELECT id, x, ({static})::DOUBLE AS s FROM sig)"
    return f"""WITH RECURSIVE {base},
    walk AS (
      SELECT 0 AS t, id, x, s, 1.0::DOUBLE AS near FROM base
      UNION ALL
      SELECT w.t + 1, w.id, w.x, w.s, CASE WHEN w.t = 0 THEN list_distance(w.x, p.x) / {scale}
        ELSE least(w.near, list_distance(w.x, p.x) / {scale}) END
      FROM walk w, (SELECT id, x FROM walk ORDER BY {gain} DESC, id LIMIT 1) p
      WHERE w.id <> p.id AND w.t < {picks})
    SELECT t + 1 AS rank, id, round(gain, 6) AS gain FROM (
      SELECT t, id, {gain} AS gain, row_number() OVER (PARTITION BY t ORDER BY {gain} DESC, id) AS rn FROM walk)
    WHERE rn = 1 AND t < {picks}"""


@query("greedy_kcenter", _greedy_sql("0.0", 1.0, 0.0, 1.0, 50))
def greedy_kcenter(spark, folder):
    found = greedy.k_center(vectors(spark, folder), 50)
    return found.withColumn("gain", F.round("gain", 6))


@query(
    "submodular_greedy",
    f"""WITH {E}, p AS ({_greedy_sql("0.0", 1.0, 0.0, 1.0, 20)}),
    g AS (SELECT e.id, p.rank, min(list_distance(e.x, c.x)) OVER (PARTITION BY e.id ORDER BY p.rank) AS gain FROM e, p JOIN e c ON c.id = p.id),
    l AS (SELECT *, min(gain) OVER (PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM g)
    SELECT count(low) AS checks, count(*) FILTER (WHERE low < gain - 1e-6) AS violations,
      round(count(*) FILTER (WHERE low < gain - 1e-6) / count(low), 6) AS violation_rate FROM l""",
)
def submodular_greedy(spark, folder):
    """The marginal gain of every vector after each of the first 20 greedy picks: the sets of picks are nested."""
    df = vectors(spark, folder)
    picks = greedy.k_center(df, 20).join(df.select("id", "x"), "id")
    ordered = picks.agg(F.sort_array(F.collect_list(F.struct("rank", "x"))).alias("c")).select("c.x").scalar()
    apart = F.transform(F.col("_c"), lambda c: F.sqrt(V.squared_distance(F.col("x"), c)))
    lowest = lambda d: F.transform(d, lambda _, i: F.array_min(F.slice(d, F.lit(1), i + 1)))
    gains = df.withColumn("_c", ordered).select("id", F.posexplode(V.let(apart, lowest)).alias("rank", "gain"))
    found = greedy.submodular_check(materialise(gains), "id", "rank", "rank", "gain")
    return found.withColumn("violation_rate", F.round("violation_rate", 6))


_POOL_SQL = f"""{SCORED},
    pool AS (SELECT *, ({_keywords(T.DOMAIN_KEYWORDS["code"])})::DOUBLE / {len(T.DOMAIN_KEYWORDS["code"])} AS d FROM scored ORDER BY d DESC, doc_id LIMIT 100),
    base AS (SELECT doc_id AS id, [quality, complexity, least(n_words / 1000, 1.0::DOUBLE)] AS x,
      0.4::DOUBLE * d + 0.3::DOUBLE * quality
        + 0.3::DOUBLE * (CASE WHEN n_words < 100 THEN 0.2 WHEN n_words < 300 THEN 0.5 ELSE 0.3 END)::DOUBLE * complexity AS s FROM pool)"""


@query("select_adaptive", _greedy_sql("", 0.3, 0.05, 1.0, 20, _POOL_SQL))
def select_adaptive(spark, folder):
    """Twenty texts: those nearest to a domain, five times the budget, scored with the curriculum, then picked one by one with
    a discount and a reward for distance to the picks."""
    relevance = T.domain_relevance(F.col("text"), "code")
    docs = scored_documents(spark, folder).select("doc_id", "quality", "complexity", "n_words", relevance.alias("d"))
    pool = select.top_k(materialise(docs), "d", "doc_id", 100)
    preferred = combine.curriculum_sum(
        {"domain": F.col("d"), "quality": F.col("quality"), "difficulty": F.col("complexity")},
        {"domain": 0.4, "quality": 0.3, "difficulty": 0.3}, T.difficulty_level(F.col("n_words")),
        {"easy": 0.2, "medium": 0.5, "hard": 0.3},
    )
    x = F.array("quality", "complexity", F.least(F.col("n_words") / 1000, F.lit(1.0)))
    rows = pool.select(F.col("doc_id").alias("id"), x.alias("x"), preferred.alias("static"))
    found = greedy.greedy_select(rows, 20, static="static", weight=0.3, rate=0.05)
    return found.withColumn("gain", F.round("gain", 6))


@query("greedy_weighted", _greedy_sql(f"{NORM_E} * {NORM_X}", 0.5, 0.01, 8.0, 50))
def greedy_weighted(spark, folder):
    scored = signal_table(spark, folder).withColumn("static", S.grad_magnitude(P(), Y(), X()))
    found = greedy.greedy_select(scored, 50, static="static", weight=0.5, rate=0.01, scale=8.0)
    return found.withColumn("gain", F.round("gain", 6))


@query("greedy_lazy", _greedy_sql(ENTROPY, 1.0, 0.05, 1.0, 100))
def greedy_lazy(spark, folder):
    """The same objective with a small pool, so that bounds decide when to score again."""
    scored = signal_table(spark, folder).withColumn("static", S.uncertainty(P()))
    found = greedy.greedy_select(scored, 100, static="static", weight=1.0, rate=0.05, pool=64)
    return found.withColumn("gain", F.round("gain", 6))


@query(
    "greedy_coreset",
    f"""WITH exact AS ({_greedy_sql(f"{NORM_E} * {NORM_X}", 0.5, 0.0, 8.0, 50)})
    SELECT 50 AS picks, 50::BIGINT AS distinct_picks, round(sum(gain), 4) AS exact_gain, true AS within_five_percent FROM exact""",
)
def greedy_coreset(spark, folder):
    """Picks of parts, merged under a descending threshold, and the gain of the one-by-one selection."""
    scored = materialise(signal_table(spark, folder).select("id", "x", S.grad_magnitude(P(), Y(), X()).alias("static")))
    exact = greedy.greedy_select(scored, 50, static="static", weight=0.5, scale=8.0).agg(F.sum("gain").alias("g"))
    found = greedy.greedy_coreset(scored, 50, static="static", weight=0.5, scale=8.0, part_rows=512)
    both = found.agg(F.count("*").cast("int").alias("picks"), F.countDistinct("id").alias("distinct_picks"), F.sum("gain").alias("f")).withColumn("g", exact.scalar())
    return both.select("picks", "distinct_picks", F.round("g", 4).alias("exact_gain"), (F.col("f") >= 0.95 * F.col("g")).alias("within_five_percent"))
