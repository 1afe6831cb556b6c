"""Quality rules learned as a decision list, and the per-document counts they look at.

Sequential covering: a rule is a conjunction of thresholds on document
statistics. It is grown one condition at a time by information gain on two
thirds of the labelled sample, then shortened from its end while that raises
its value on the other third. A rule that pays is kept, the rows it covers go,
and the next rule is grown. The list becomes one Spark conditional expression,
so applying it needs no Python.

Edge cases: a null or empty text has no words, all counts are 0 and it fails
the base rules. A text of any length is one row; nothing is exploded. Repeated
rows and ties are judged alike. An empty table gives no rows. Without labelled
rows, or with labels of one kind only, the list is empty and keeps everything.
Other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import BLANKS, beside, count_of, let, sample_by_hash, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEATURES = (
    "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share",
    "top_pair_share",
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words lying in a window of `window` words that occurs twice or more in the text.

    Windows are compared by 64-bit hashes of hashes. A text whose windows are all
    different, the usual case, is done after one distinct; else equal windows are
    found next to each other after a sort, and each adds the words that the window
    before it did not cover yet.
    """

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            def alike(k: Column) -> Column:
                same = lambda j: F.get(s, j)["h"] == F.get(s, k)["h"]
                return F.coalesce(same(k - 1), F.lit(False)) | F.coalesce(same(k + 1), F.lit(False))

            places = F.sort_array(
                F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), alike), lambda k: F.get(s, k)["i"])
            )
            step = lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(window), p - acc["at"])).cast("long").alias("n"), p.alias("at")
            )
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("at"))
            return F.aggregate(places, start, step, lambda acc: acc["n"])

        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(pairs), of_sorted)
        )

    def windows(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(window)]))

    inside = let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashed: let(windows(hashed), covered))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(inside)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rule features in one struct `_stats`."""
    whole = F.coalesce(F.col(text), F.lit(""))

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        chars = F.length(F.translate(whole, BLANKS, "")).cast("long")
        lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
        per_line = let(
            lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("d"))
        )
        return F.struct(
            n.alias("n_words"), chars.alias("word_chars"),
            count_of(whole, SYMBOLS).cast("long").alias("n_symbols"),
            per_line["d"].alias("n_dup_lines"), per_line["n"].alias("n_lines"),
            repeated_words(words).alias("n_repeat_words"),
            count_of(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
            count_of(whole, "!?").cast("long").alias("n_marks"),
            F.size(F.array_distinct(words)).alias("n_distinct"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).alias("n_echo"),
        )

    counted = df.withColumn("_words", words_of(F.col(text)))
    # a struct keeps the counts clear of the caller's column names
    return counted.withColumn("_stats", let(F.col("_words"), of)).drop("_words")


def features(stats: Column) -> dict[str, Column]:
    """Shares of words, characters or lines: numbers that do not grow with the text."""
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(stats["word_chars"], F.lit(1)).cast("double")
    # long texts repeat common words, so distinct words are held against a power of the length
    return {
        "word_length": stats["word_chars"] / words,
        "symbol_share": stats["n_symbols"] / words,
        "dup_line_share": stats["n_dup_lines"] / F.greatest(stats["n_lines"], F.lit(1)),
        "repeat_share": stats["n_repeat_words"] / words,
        "upper_share": stats["n_upper"] / chars,
        "mark_share": stats["n_marks"] / words,
        "distinct_share": stats["n_distinct"] / F.pow(words, F.lit(0.8)),
        "top_pair_share": stats["n_echo"] / words,
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """Rejects a row when all conditions (feature, is_above, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float = 1.0

    def covers(self, row: dict[str, float]) -> bool:
        return all(row[f] > t if above else row[f] <= t for f, above, t in self.conditions)

    def column(self, values: dict[str, Column]) -> Column:
        parts = [values[f] > t if above else values[f] <= t for f, above, t in self.conditions]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole & p
        return whole

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if above else '<='} {t:.4g}" for f, above, t in self.conditions)


def _gain(before: tuple[int, int], after: tuple[int, int]) -> float:
    (p0, n0), (p1, n1) = before, after
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 and p0 else -1.0


def _split(rows: list[tuple[dict[str, float], bool]]) -> tuple[int, int]:
    bad = sum(b for _, b in rows)
    return bad, len(rows) - bad


def _grow(rows: list[tuple[dict[str, float], bool]], names: Sequence[str], most: int) -> Rule:
    """Adds the condition of the largest gain until no good row is covered. Thresholds lie midway between neighbours of
    unlike label."""
    conditions: list[tuple[str, bool, float]] = []
    while len(conditions) < most:
        total = _split(rows)
        if not total[1]:
            break
        best: tuple[float, tuple[str, bool, float]] | None = None
        for name in names:
            ordered = sorted((r[name], b) for r, b in rows)
            below = [0, 0]
            for k, (value, bad) in enumerate(ordered[:-1]):
                below[not bad] += 1
                following, next_bad = ordered[k + 1]
                if following == value or (next_bad == bad and k and ordered[k - 1][1] == bad):
                    continue
                cut = (value + following) / 2
                above = (total[0] - below[0], total[1] - below[1])
                for side, counts in ((False, tuple(below)), (True, above)):
                    found = (_gain(total, counts), (name, side, cut))
                    if best is None or found[0] > best[0]:
                        best = found
        if best is None or best[0] <= 1e-9:
            break
        conditions.append(best[1])
        rows = [(r, b) for r, b in rows if Rule((best[1],)).covers(r)]
    return Rule(tuple(conditions))


def _prune(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> tuple[Rule, float, int]:
    """The prefix of the rule with the best (bad - good) / covered on rows it was not grown on."""

    def value(r: Rule) -> tuple[float, float, int]:
        bad, good = _split([x for x in rows if r.covers(x[0])])
        n = bad + good
        return ((bad - good) / n if n else -1.0), (bad + 1) / (n + 2), n

    options = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    best = max(options, key=lambda r: (value(r)[0], value(r)[2], -len(r.conditions)))
    worth, precision, n = value(best)
    return Rule(best.conditions, round(precision, 6)), worth, n


def learn(
    sample: Sequence[tuple[dict[str, float], bool]], names: Sequence[str] = FEATURES, max_rules: int = 12,
    max_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 5,
) -> list[Rule]:
    """Rules for the bad rows of a labelled sample, in the order they were found.

    Every third row prunes. A rule whose smoothed precision there is below
    `least_precision` ends the search: clean rows must not be lost to a weak rule.
    """
    grow = [x for k, x in enumerate(sample) if k % 3 != 2]
    prune = [x for k, x in enumerate(sample) if k % 3 == 2]
    rules: list[Rule] = []
    while len(rules) < max_rules and _split(grow)[0] >= least_rows and _split(grow)[1]:
        rule = _grow(grow, names, max_conditions)
        if not rule.conditions:
            break
        rule, worth, n = _prune(rule, prune)
        if n < least_rows or rule.precision < min(least_precision, (n + 1) / (n + 2)) or worth <= 0:
            break
        rules.append(rule)
        grow = [x for x in grow if not rule.covers(x[0])]
        prune = [x for x in prune if not rule.covers(x[0])]
    return rules


def fit(
    documents: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = 6000,
) -> list[Rule]:
    """Learns from at most `sample_rows` labelled documents (label 0 is bad), the first by a hash of their id.

    Only the statistics of the sample reach the driver, `sample_rows` rows of
    eight numbers.
    """
    known = sample_by_hash(labels.filter(F.col(label).isNotNull() & F.col(ident).isNotNull()).select(ident, label), ident, sample_rows)
    texts = documents.select(ident, F.col(text).alias("text")).join(F.broadcast(known), ident)
    described = statistics(texts)
    values = features(F.col("_stats"))
    # a filter on the statistics would be pushed below the join and compute them for every document
    rows = described.select(
        F.col(ident).alias("_id"), (F.col(label) == 0).alias("_bad"), base_failed(F.col("_stats")).alias("_failed"),
        *[values[f].alias(f) for f in FEATURES],
    ).collect()
    rows = [r for r in rows if not r["_failed"]]
    rows.sort(key=lambda r: (hash_order(r["_id"]), r["_id"]))
    return learn([({f: float(r[f]) for f in FEATURES}, bool(r["_bad"])) for r in rows])


def hash_order(ident: int) -> int:
    """An order that has nothing to do with the id's size, for dealing rows to growing and pruning."""
    return (int(ident) * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64) >> 20


def verdict(rules: Sequence[Rule], values: dict[str, Column]) -> Column:
    """The number of the first rule that fires, from 1, or 0: an ordered conditional expression."""
    if not rules:
        return F.lit(0)
    expression = F.when(rules[0].column(values), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        expression = expression.when(rule.column(values), F.lit(k))
    return F.coalesce(expression, F.lit(0))


def judge(documents: DataFrame, rules: Sequence[Rule], text: str = "text", out: str = "_quality") -> DataFrame:
    """Adds a struct: the counts, base_failed, the number of the rule that fired and kept."""

    def build(packed: DataFrame) -> DataFrame:
        stats = F.col("_stats")
        described = statistics(packed, "_t").withColumn("_fired", verdict(rules, features(stats)))
        failed = base_failed(stats)
        counts = [stats[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        kept = ~failed & (F.col("_fired") == 0)
        return described.withColumn("_out", F.struct(*counts, failed.alias("base_failed"), F.col("_fired").alias("rule"), kept.alias("kept")))

    return beside(documents, text, build, {"_out": out})
