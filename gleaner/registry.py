"""Named scorers that users can add to, and the strategies that pick among them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import signals as S
from gleaner.functions import text as T
from gleaner.operators.combine import composed, weighted_sum
from gleaner.operators.neighbours import min_distance
from gleaner.operators.select import top_k


@dataclass(frozen=True)
class Scorer:
    """A score as a column over the frame's columns.

    `requires` names the columns it reads. `fn` may return a built-in
    expression or a pandas UDF call. `submodular` and `granularity` describe it.
    """

    name: str
    requires: tuple[str, ...]
    fn: Callable[[DataFrame], Column]
    submodular: bool = False
    granularity: str = "document"


class ScorerRegistry:
    def __init__(self, scorers: Iterable[Scorer] = ()):
        self._scorers = {s.name: s for s in scorers}

    def register(self, name: str, requires: Sequence[str], fn, submodular: bool = False, granularity: str = "document") -> None:
        if name in self._scorers:
            raise ValueError(f"scorer exists already: {name}")
        self._scorers[name] = Scorer(name, tuple(requires), fn, submodular, granularity)

    def names(self) -> list[str]:
        return list(self._scorers)

    def requires(self, name: str) -> tuple[str, ...]:
        return self._scorers[name].requires

    def subset(self, names: Sequence[str]) -> "ScorerRegistry":
        return ScorerRegistry([self._scorers[n] for n in names])

    def apply(self, df: DataFrame) -> DataFrame:
        """Adds (or replaces) one column per scorer in a single projection."""
        for s in self._scorers.values():
            missing = set(s.requires) - set(df.columns)
            if missing:
                raise ValueError(f"{s.name} needs {sorted(missing)}")
        return df.withColumns({name: s.fn(df) for name, s in self._scorers.items()})

    def combine(self, df: DataFrame, weights: dict[str, float], out: str = "score") -> DataFrame:
        scored = self.subset([n for n in weights if n in self._scorers]).apply(df)
        return scored.withColumn(out, weighted_sum({n: F.col(n) for n in weights if n in self._scorers}, weights))


def text_scorers(progress: float = 0.0, domain: str = "code") -> ScorerRegistry:
    """Document scores over (text, words), the loss of a language model, the distance to what is selected and a difficulty."""
    text, words = F.col("text"), F.col("words")
    return ScorerRegistry([
        Scorer("quality", ("text", "words"), lambda _: T.quality_rci(text, words)["score"]),
        Scorer("domain_relevance", ("text",), lambda _: T.domain_relevance(text, domain)),
        Scorer("curriculum", ("words",), lambda _: T.curriculum(F.size(words), progress)),
        Scorer("perplexity", ("loss",), lambda _: F.exp("loss")),
        Scorer("semantic_diversity", ("min_distance",), lambda _: F.coalesce("min_distance", F.lit(1.0)), True),
        Scorer("difficulty", ("words",), lambda _: T.complexity(text, words)),
    ])


def signal_scorers() -> ScorerRegistry:
    """Sample scores over (p, y, x), the distance to what is selected and the share of rises among the last losses."""
    p, y, x = F.col("p"), F.col("y"), F.col("x")
    return ScorerRegistry([
        Scorer("grad_mag", ("p", "y", "x"), lambda _: S.grad_magnitude(p, y, x), True, "sample"),
        Scorer("uncertainty", ("p",), lambda _: S.uncertainty(p), False, "sample"),
        Scorer("boundary", ("p",), lambda _: S.boundary(p), False, "sample"),
        Scorer("influence", ("p", "y", "x"), lambda _: S.influence(p, y, x), True, "sample"),
        Scorer("diversity", ("min_distance",), lambda _: F.coalesce("min_distance", F.lit(1.0)), True, "sample"),
        Scorer("forgetting", ("forgetting",), lambda _: F.coalesce("forgetting", F.lit(0.0)), False, "sample"),
    ])


# Names of the selection strategies.
STRATEGIES = (
    "grad_mag", "grad_var", "influence", "diversity", "uncertainty",
    "grad_conflict", "forgetting", "hybrid", "weighted", "composed",
)


def select_with(
    strategy: str, df: DataFrame, k: int, ident: str = "id", selected: DataFrame | None = None,
    weights: dict[str, float] | None = None, terms: Sequence[tuple[str, str, float]] | None = None,
) -> DataFrame:
    """(ident, score) of the k rows a named strategy picks from (id, x, p, y).

    `weighted` takes the weights of the signal scorers; without them it is the
    gradient strategy, and so is `composed` without terms. Unknown names raise.
    """
    p, y, x = F.col("p"), F.col("y"), F.col("x")
    if strategy == "composed" and terms or strategy == "weighted" and weights:
        # the scorers whose columns the frame has
        every = signal_scorers()
        usable = every.subset([n for n in every.names() if set(every.requires(n)) <= set(df.columns)])
        scored = usable.apply(df)
        if strategy == "weighted":
            score = weighted_sum({n: F.col(n) for n in usable.names()}, weights)
        else:
            score = composed([F.col(t[0]) for t in terms], [t[1] for t in terms[1:]], [t[2] for t in terms])
        scored = scored.withColumn("score", score)
    elif strategy in ("grad_mag", "grad_var", "influence", "grad_conflict", "weighted", "composed"):
        scored = df.withColumn("score", S.grad_norm_sum(p, y, x))
    elif strategy in ("uncertainty", "forgetting"):
        scored = df.withColumn("score", S.uncertainty(p))
    elif strategy == "hybrid":
        scored = df.withColumn("score", S.hybrid(p, y, x))
    elif strategy == "diversity":
        near = df.withColumn("score", F.lit(1.0)) if selected is None else min_distance(df, selected, "x", ident, "score")
        scored = near.withColumn("score", F.coalesce("score", F.lit(1.0)))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return top_k(scored.select(ident, "score"), "score", ident, k)
