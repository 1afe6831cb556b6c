"""A population of composed strategies as a table.

A strategy is a list of terms (score name, operator, weight), folded from the
left; the first operator is not used.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.scale import against, hash_key
from gleaner.session import materialise, scratch_path

OPERATORS = ("add", "multiply", "max", "min")
STRATEGY_SCHEMA = "strategy int, terms array<struct<score:string,op:string,weight:double>>"
FOLD = {"add": np.add, "multiply": np.multiply, "max": np.fmax, "min": np.fmin}


def uniform(*parts: Column | str | int) -> Column:
    """Repeatable uniform number in [0, 1) from ids and seeds: 52 bits of an md5."""
    joined = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") / float(1 << 52)


def initial_population(spark: SparkSession, scores: Sequence[str], size: int = 50, seed: int = 0) -> DataFrame:
    """`size` strategies of 2 or 3 terms with weights in [0.1, 1)."""
    names = F.array(*[F.lit(s) for s in scores])
    ops = F.array(*[F.lit(o) for o in OPERATORS])

    def draw(options: Column, n: int, *parts) -> Column:
        return F.element_at(options, (F.floor(uniform(*parts) * n) + 1).cast("int"))

    me = F.col("strategy")
    length = F.floor(uniform(seed, "length", me) * 2).cast("int") + 2
    terms = F.transform(
        F.sequence(F.lit(1), length),
        lambda i: F.struct(
            draw(names, len(scores), seed, "score", me, i).alias("score"),
            draw(ops, len(OPERATORS), seed, "op", me, i).alias("op"),
            (0.1 + 0.9 * uniform(seed, "weight", me, i)).alias("weight"),
        ),
    )
    return spark.range(size).select(F.col("id").cast("int").alias("strategy")).withColumn("terms", terms)


def score_rows(columns: dict[str, np.ndarray], terms: list[dict]) -> np.ndarray:
    """Scores of all rows of a block under one strategy: the weighted terms, folded from the left."""
    result = columns[terms[0]["score"]] * terms[0]["weight"]
    for t in terms[1:]:
        result = FOLD[t["op"]](result, columns[t["score"]] * t["weight"])
    return result


class Best:
    """The `k` best rows of each strategy so far: (score, id, metric), ties to the lower id.

    A strategy's rows are cut back to k whenever they reach `slack` times k, which sets its
    bar; only rows that reach the bar are kept at all. Two of these merge by their rows.
    """

    def __init__(self, k: int, slack: int = 4):
        self.k, self.slack, self.held = k, slack, 0
        self.rows: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.bar: dict[int, float] = {}
        self.size: dict[int, int] = {}

    def add(self, strategy: int, score: np.ndarray, ident: np.ndarray, metric: np.ndarray) -> None:
        score = np.where(np.isnan(score), -np.inf, score)
        bar = self.bar.get(strategy)
        if bar is not None:
            at = np.flatnonzero(score >= bar)
            if not len(at):
                return
            score, ident, metric = score[at], ident[at], metric[at]
        self.rows.setdefault(strategy, []).append((score, ident, metric))
        self.size[strategy] = self.size.get(strategy, 0) + len(score)
        self.held += len(score)
        if self.size[strategy] >= self.slack * self.k:
            self._cut(strategy)

    def _cut(self, strategy: int) -> None:
        score, ident, metric = (np.concatenate(x) for x in zip(*self.rows[strategy], strict=True))
        order = np.lexsort((ident, -score))[: self.k]
        self.rows[strategy] = [(score[order], ident[order], metric[order])]
        self.held += len(order) - self.size[strategy]
        self.size[strategy] = len(order)
        if len(order) == self.k:
            self.bar[strategy] = float(score[order[-1]])

    def drain(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """At most k rows of each strategy; nothing is left."""
        for strategy in list(self.rows):
            self._cut(strategy)
            yield (strategy, *self.rows.pop(strategy)[0])
        self.rows, self.bar, self.size, self.held = {}, {}, {}, 0


def best_rows(rows: DataFrame, strategies: DataFrame, ident: str, kind: str, metric: str, k: int, block_rows: int = 8192, members: int = 512, most: int = 4_000_000) -> DataFrame:
    """(strategy, score, ident, metric): at most `k` rows of each strategy from each task.

    Blocks of rows meet blocks of strategies, both as data; a task holds at most about `most` rows before it hands them on.
    """

    def of(pairs: Iterator) -> Iterator[pd.DataFrame]:
        best, last, columns = Best(k), None, {}

        def out() -> Iterator[pd.DataFrame]:
            for strategy, score, ids, values in best.drain():
                yield pd.DataFrame({"strategy": np.int32(strategy), "score": score, ident: ids, metric: values})

        for block, table, _, population in pairs:
            if block != last:
                last = block
                columns = {c: table.column(c).to_numpy() for c in table.column_names}
            for s in population.to_pylist():
                best.add(s["strategy"], score_rows(columns, s["terms"]), columns[ident], columns[metric])
            if best.held > most:
                yield from out()
        yield from out()

    schema = f"strategy int, score double, {ident} {kind}, {metric} double"
    return against(rows, strategies.select("strategy", "terms"), of, schema, block_rows, members)


def narrow(df: DataFrame, ident: str, metric: str, scores: Sequence[str] | None = None) -> DataFrame:
    """What `fitness_of` reads: id, metric and scores, all other numeric columns unless named."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in (ident, metric)]
    return df.select(ident, *[F.col(c).cast("double").alias(c) for c in [metric, *(scores or numeric)]])


def fitness_of(rows: DataFrame, strategies: DataFrame, ident: str, kind: str, metric: str, k: int) -> DataFrame:
    best = Window.partitionBy("strategy").orderBy(F.col("score").desc(), ident)
    return (
        best_rows(rows, strategies, ident, kind, metric, k)
        .withColumn("_at", F.row_number().over(best))
        .filter(F.col("_at") <= k)
        .groupBy("strategy")
        .agg(F.avg(metric).alias("fitness"))
    )


def evaluate(df: DataFrame, strategies: DataFrame, ident: str, metric: str, k: int, scores: Sequence[str] | None = None) -> DataFrame:
    """(strategy, fitness): mean `metric` over the top-k rows of each strategy.

    Strategies are rows, joined to the data in blocks, so neither the plan nor
    the driver grows with them and the data is read once. A task keeps k rows of a
    strategy; those of all tasks are merged by strategy. Rows with a null or NaN score
    come last; null metrics do not count.
    """
    return fitness_of(narrow(df, ident, metric, scores), strategies, ident, dict(df.dtypes)[ident], metric, k)


def tournament(fitness: DataFrame, slots: int, entrants: int = 5, seed: int = 0) -> DataFrame:
    """(slot, winner, fitness): the best of `entrants` random strategies per slot.

    Slot 0 is the best strategy of all. Ties go to the lowest strategy. The
    draw is a hash order per slot, over a population that is small by nature.
    """
    drawn = fitness.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots - 1)))).withColumn(
        "_h", hash_key(F.concat_ws(":", "slot", "strategy"), seed)
    )
    order = Window.partitionBy("slot").orderBy("_h", "strategy")
    entered = drawn.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= entrants)
    everyone = fitness.withColumn("slot", F.lit(0))
    best = F.struct(F.col("fitness"), -F.col("strategy"))
    return (
        entered.select("slot", "strategy", "fitness")
        .unionByName(everyone.select("slot", "strategy", "fitness"))
        .groupBy("slot")
        .agg(F.max_by("strategy", best).alias("winner"), F.max("fitness").alias("fitness"))
    )


def mutate(strategies: DataFrame, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """With probability `rate` shift a weight by N(0, 0.1) inside [0, 1]; with the
    same probability redraw one operator of the strategy."""
    me = F.col("strategy")
    ops = F.array(*[F.lit(o) for o in OPERATORS])
    links = F.size("terms") - 1
    target = F.floor(uniform(seed, "which", me) * links).cast("int") + 1
    redraw = (uniform(seed, "redraw", me) < rate) & (links > 0)
    operator = F.element_at(ops, (F.floor(uniform(seed, "op", me) * len(OPERATORS)) + 1).cast("int"))

    def changed(t: Column, i: Column) -> Column:
        noise = F.sqrt(-2 * F.log(1 - uniform(seed, "r", me, i))) * F.cos(2 * F.pi() * uniform(seed, "a", me, i))
        shifted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t["weight"] + 0.1 * noise))
        return F.struct(
            t["score"].alias("score"),
            F.when(redraw & (i == target), operator).otherwise(t["op"]).alias("op"),
            F.when(uniform(seed, "mutate", me, i) < rate, shifted).otherwise(t["weight"]).alias("weight"),
        )

    return strategies.withColumn("terms", F.transform("terms", changed))


def next_generation(strategies: DataFrame, fitness: DataFrame, slots: int, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """Winners of the tournament, mutated except for the elite in slot 0."""
    winners = tournament(fitness, slots, seed=seed).select("slot", F.col("winner").alias("strategy"))
    parents = winners.join(strategies, "strategy").select(F.col("slot").alias("strategy"), "terms")
    mutated = mutate(parents, rate, seed)
    return parents.filter("strategy = 0").unionByName(mutated.filter("strategy > 0"))


@dataclass(frozen=True)
class Evolution:
    """Where the generations were written, and how many there are."""

    folder: str
    generations: int

    def table(self, spark: SparkSession) -> DataFrame:
        """generation, strategy, terms and fitness of all generations."""
        return spark.read.schema(f"{STRATEGY_SCHEMA}, fitness double, generation int").parquet(self.folder)

    def history(self, spark: SparkSession) -> DataFrame:
        """A row per generation: best strategy (ties to the lowest), its terms and fitness, mean fitness, distinct strategies."""
        best = F.struct("fitness", -F.col("strategy"))
        return self.table(spark).groupBy("generation").agg(
            F.max_by("strategy", best).alias("strategy"), F.max_by("terms", best).alias("terms"), F.max("fitness").alias("best"),
            F.avg("fitness").alias("mean"), F.countDistinct("terms").alias("distinct_strategies"),
        )


def evolve(
    df: DataFrame, population: DataFrame, ident: str, metric: str, k: int, generations: int = 5, rate: float = 0.1,
    seed: int | str = 0, patience: int | None = None, tolerance: float = 0.0, folder: str | None = None, scores: Sequence[str] | None = None,
) -> Evolution:
    """A population over generations: score, write, stop or breed.

    The columns needed are written once. Each generation is written with its
    fitness (nine decimals, so that the noise of a sum decides no tie) before the next
    one is bred from the written copy; a lost executor costs one generation at most.
    It ends after `generations`, or once the best fitness has not grown by more than
    `tolerance` in `patience` generations in a row. Strategies must be numbered from 0.
    """
    spark = df.sparkSession
    folder = folder or scratch_path(spark, "generations")
    rows, kind = materialise(narrow(df, ident, metric, scores)), dict(df.dtypes)[ident]
    current, size, best, stale, done = population, population.count(), None, 0, 0
    for g in range(generations):
        fitness = fitness_of(rows, current, ident, kind, metric, k).withColumn("fitness", F.round("fitness", 9))
        path = f"{folder}/generation={g}"
        current.select("strategy", "terms").join(fitness, "strategy", "left").write.parquet(path)
        written, done = spark.read.parquet(path), g + 1
        top = written.agg(F.max("fitness")).first()[0]
        if best is None or (top is not None and top > best + tolerance):
            best, stale = top, 0
        else:
            stale += 1
        if patience is not None and stale >= patience:
            break
        current = next_generation(
            written.select("strategy", "terms"), written.select("strategy", "fitness").filter("fitness IS NOT NULL"), size, rate, f"{seed}:{g}"
        )
    return Evolution(folder, done)
