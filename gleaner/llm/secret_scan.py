"""Secrets in text: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order chains are counted from labelled strings for either class: one over
ASCII characters without their case, one over the pattern of lower case, upper case,
digits and others. So capitals as such are not random: what counts is whether letters
follow each other as in words and cases change as in names. Ordinary strings are the
long words of the sample and identifiers made of its words: camelCase, UPPER_SNAKE,
snake_case, dashes, paths and dated paths. A run of token characters is scored by the
log-likelihood ratio of the chains; a run above the bar, which rises with its length at
a rate between those that 99 of 100 distinct training strings of either class keep, is a
span of its own unless it touches a pattern's span. Strings that mix letters and
digits like a key without a pattern are of neither class, so keys in the sample do
not lift the bar. Training counts are an aggregate of at most 2 x 129 x 129 rows and a
few more; scoring is an expression inside the row.

Edge cases: null or empty text has no spans. Text of any length is one row; runs
of any length are scored whole. A match that fails its length rule is dropped
and the search goes on behind it. Repeated rows give the same spans. Without
a model nothing is added to the patterns' spans. An empty table gives
no rows; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import beside, double_array, let, sample_texts
from gleaner.session import materialise

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Kind, pattern, group whose length counts, least length.
PATTERNS = (("assign", ASSIGN, 2, 6), ("access", "(AKIA[A-Z0-9]{16,})", 1, 20), ("hex", "([0-9a-f]{24,})", 1, 24))
KINDS = ("assign", "access", "hex", "markov")
LEAST_RUN = 20
RUN = f"([A-Za-z0-9+/_=-]{{{LEAST_RUN},}})"
STATES = 129  # 0 starts a string, 1 to 128 are ASCII
#: Places between a letter and a digit; a string with three of them, and one per ten characters, is not labelled.
MIX = "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
SPAN = "array<struct<start:bigint,kind:int,end:bigint,body:string>>"


#: Alphabets of keys.
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789ABCDEF", "0123456789abcdef",
)
CASES = 5  # 0 starts a string, then lower case, upper case, digit, other


def _codes(token: Column) -> Column:
    return F.transform(F.split(F.lower(token), ""), lambda c: F.least(F.ascii(c), F.lit(127)) + 1)


def _cases(token: Column) -> Column:
    of = lambda c: F.when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).when(c.between("0", "9"), 3).otherwise(4)
    return F.transform(F.split(token, ""), of)


def _mixed(token: Column) -> Column:
    return F.regexp_count(token, F.lit(MIX)) >= F.greatest(F.lit(3), F.length(token) / 10)


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios by state * STATES + next state, those of the case pattern alike, and the score a run must exceed: in
    all, and more per character."""

    ratios: tuple[float, ...]
    cases: tuple[float, ...]
    threshold: float
    rate: float = 0.0

    def bar(self, token: Column) -> Column:
        return F.length(token) * self.rate + self.threshold

    def score(self, token: Column) -> Column:
        def of(codes: Column, ratios: Column, states: int) -> Column:
            step = lambda acc, c: F.struct(
                (acc["v"] + F.get(ratios, acc["p"] * states + c)).alias("v"), c.alias("p")
            )
            return F.aggregate(codes, F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("p")), step, lambda acc: acc["v"])

        characters = let(_codes(token), lambda codes: of(codes, double_array(self.ratios), STATES))
        return characters + let(_cases(token), lambda codes: of(codes, double_array(self.cases), CASES))


def train(
    samples: DataFrame, token: str = "token", secret: str = "secret", smoothing: float = 0.1, margin: float = 6.0, share: float = 0.99,
    lean: float = 2 / 3,
) -> Model | None:
    """Counts the chains from labelled strings. None if either label is missing.

    The bar is `margin`, a natural logarithm of odds, above a score per character between the one that `share` of the
    distinct ordinary strings as long as a run do not exceed and the one that as many random ones do: `lean` of the
    way, as names of other words than the sample's come closer to random ones. It is never below 0.
    """
    def steps(codes: Column, chain: int) -> Column:
        before = lambda c, i: F.coalesce(F.when(i > 0, F.get(c, i - 1)), F.lit(0))
        return let(codes, lambda c: F.transform(c, lambda x, i: F.struct(F.lit(chain).alias("k"), before(c, i).alias("a"), x.alias("b"))))

    usable = samples.filter(F.length(token) > 0)
    counts = (
        usable.select(F.col(secret).alias("_s"), F.explode(F.concat(steps(_codes(F.col(token)), 0), steps(_cases(F.col(token)), 1))).alias("_p"))
        .groupBy("_s", "_p.k", "_p.a", "_p.b").count().collect()
    )
    chains: tuple[dict, dict] = ({True: {}, False: {}}, {True: {}, False: {}})
    for s, k, a, b, n in counts:
        chains[k][bool(s)][a, b] = n
    if not chains[0][True] or not chains[0][False]:
        return None
    free = Model(_ratios(chains[0], STATES, smoothing), _ratios(chains[1], CASES, smoothing), 0.0)
    distinct = usable.filter(F.length(token) >= LEAST_RUN).select(F.col(token).alias("_w"), F.col(secret).alias("_s")).distinct()
    each = free.score(F.col("_w")) / F.length("_w")
    high, low = distinct.agg(
        F.percentile(F.when(~F.col("_s"), each), share), F.percentile(F.when(F.col("_s"), each), 1 - share)
    ).first()
    high = high or 0.0
    rate = high if low is None else high + lean * max(0.0, low - high)
    return Model(free.ratios, free.cases, margin, round(max(0.0, rate), 6))


def _ratios(chains: dict[bool, dict[tuple[int, int], int]], states: int, smoothing: float) -> tuple[float, ...]:
    seen = {b for chain in chains.values() for _, b in chain}
    starts = {b for chain in chains.values() for a, b in chain if not a}  # a first character that neither class has says nothing
    totals: dict[bool, dict[int, int]] = {s: {} for s in chains}
    for s, chain in chains.items():
        for (a, _), n in chain.items():
            totals[s][a] = totals[s].get(a, 0) + n

    def log_probability(s: bool, a: int, b: int) -> float:
        return math.log((chains[s].get((a, b), 0) + smoothing) / (totals[s].get(a, 0) + smoothing * (len(seen) + 1)))

    return tuple(
        round(log_probability(True, a, b) - log_probability(False, a, b), 6) if a or b in starts else 0.0
        for a in range(states) for b in range(states)
    )


def _located(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the pattern in code points: gaps and matches add up to the places.

    Only texts that hold a match are taken apart.
    """

    def spans(both: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, m: Column) -> Column:
            begin = acc["at"] + m["gap"]
            end = begin + F.length(m["whole"])
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m["body"].alias("body"))
            keep = F.length(m["body"]) >= least
            return F.struct(end.alias("at"), F.when(keep, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(both, start, step, lambda acc: acc["out"])

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("bigint"))
    rows = F.arrays_zip(
        gaps.alias("gap"), whole.alias("whole"), body.alias("body"),
    )
    matched = F.filter(rows, lambda m: m["whole"].isNotNull())
    return F.when(text.rlike(pattern), spans(matched)).otherwise(F.array().cast(SPAN))


def spans_of(text: Column, model: Model | None) -> Column:
    """Array of (start, kind, end, body), ordered by start, then kind as in KINDS."""
    found = [_located(text, pattern, group, least, k) for k, (_, pattern, group, least) in enumerate(PATTERNS)]
    base = F.array_sort(F.concat(*found))
    if model is None:
        return base

    def with_runs(base: Column) -> Column:
        runs = _located(text, RUN, 1, LEAST_RUN, len(PATTERNS))
        apart = lambda r: ~F.exists(base, lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
        random = F.filter(runs, lambda r: apart(r) & (model.score(r["body"]) > model.bar(r["body"])))
        return F.array_sort(F.concat(base, random))

    return let(base, with_runs)


def scan(documents: DataFrame, model: Model | None, text: str = "text", out: str = "_secrets") -> DataFrame:
    """Adds the spans of every text."""
    whole = F.coalesce(F.col("_t"), F.lit(""))
    return beside(documents, text, lambda d: d.withColumn("_out", spans_of(whole, model)), {"_out": out})


def identifiers(text: Column, words: int) -> Column:
    """Names as programs have them, made of the text's words: `words` distinct ones by the order of a hash, three in a name."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(?<![A-Za-z0-9+/_=-])([A-Za-z]{3,12})(?![A-Za-z0-9+/_=-])"), F.lit(1)))
    drawn = F.transform(F.slice(F.array_sort(F.transform(found, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), 1, words), lambda x: x["w"])

    def names(w: Column, i: Column) -> Column:
        parts = F.slice(w, i * 3 + 1, F.lit(3))
        lower = F.transform(parts, lambda x: F.lower(x))
        title = F.transform(parts, lambda x: F.initcap(F.lower(x)))
        year = (F.lit(1990) + F.pmod(F.xxhash64(F.get(parts, F.lit(0))), F.lit(40))).cast("string")
        rest = F.slice(lower, 2, 2)
        return F.array(
            F.concat(F.get(lower, F.lit(0)), F.array_join(F.slice(title, 2, 2), "")), F.array_join(title, ""), F.upper(F.array_join(parts, "_")),
            F.array_join(lower, "_"), F.array_join(lower, "-"), F.array_join(lower, "/"), F.concat_ws("/", F.get(lower, F.lit(0)), year, F.array_join(rest, "-")),
        )

    groups = lambda w: F.flatten(F.transform(F.sequence(F.lit(0), (F.size(w) / 3).cast("int") - 1), lambda i: names(w, i)))
    return let(drawn, lambda w: F.when(F.size(w) >= 3, groups(w)).otherwise(F.array().cast("array<string>")))


def random_strings(spark: SparkSession, each: int) -> DataFrame:
    """`each` strings of 24 to 48 characters of every alphabet, drawn by hashes."""
    alphabet = F.get(F.array(*[F.lit(a) for a in ALPHABETS]), (F.col("id") % len(ALPHABETS)).cast("int"))

    def of(letters: Column) -> Column:
        places = F.sequence(F.lit(1), F.lit(24) + F.pmod(F.xxhash64("id"), F.lit(25)))
        return F.array_join(F.transform(places, lambda j: F.substring(letters, (F.pmod(F.xxhash64("id", j), F.length(letters)) + 1).cast("int"), F.lit(1))), "")

    return spark.range(each * len(ALPHABETS)).select(let(alphabet, of).alias("token"))


def labelled_strings(documents: DataFrame, ident: str = "doc_id", text: str = "text", sample_docs: int = 4000, identifier_words: int = 30, random_keys: int = 400) -> DataFrame:
    """Strings to learn from: bodies of the fixed patterns and `random_keys` of each alphabet are secrets; words of eight or more token characters in texts
    without any pattern are ordinary, but for those that mix letters and digits, and so are identifiers made of
    `identifier_words` words of such a text. At most `sample_docs` documents of either sort, the first by a hash of their id."""
    plain = documents.select(F.col(ident).alias("_id"), F.col(text).alias("_t"))
    whole = F.coalesce(F.col("_t"), F.lit(""))
    hits = F.lit(False)
    for _, pattern, _, _ in PATTERNS:
        hits = hits | whole.rlike(pattern)
    with_hits = sample_texts(plain.filter(hits), "_id", sample_docs)
    without = sample_texts(plain, "_id", sample_docs).filter(~hits)
    secrets = scan(with_hits, None, "_t").select(F.explode("_secrets.body").alias("token")).withColumn("secret", F.lit(True))
    long = F.array_distinct(F.regexp_extract_all("_t", F.lit("([A-Za-z0-9+/_=-]{8,})"), F.lit(1)))
    words = without.select(F.explode(F.concat(F.filter(long, lambda w: ~_mixed(w)), identifiers(F.col("_t"), identifier_words))).alias("token"))
    # lines drawn with one character
    rulers = documents.sparkSession.createDataFrame([(c * n,) for c in "_-=+/" for n in range(LEAST_RUN, 4 * LEAST_RUN)], "token string")
    words = words.union(rulers).withColumn("secret", F.lit(False))
    secrets = secrets.union(random_strings(documents.sparkSession, random_keys).withColumn("secret", F.lit(True)))
    return materialise(secrets.union(words))  # counted and then scored: written once, bounded by the sample


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])
    return F.concat_ws(",", F.transform(spans, one))


def redact(documents: DataFrame, model: Model | None, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span in the text replaced by `mark`; overlapping spans become one."""
    whole = F.coalesce(F.col("_t"), F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], before, F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], new).otherwise(acc["out"]).alias("out")
        )

    end = lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole)))
    cleaned = let(spans_of(whole, model), lambda spans: F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(F.col("_t")))
    columns = documents.columns
    return beside(documents, text, lambda d: d.withColumn("_out", cleaned), {"_out": text}).select(*[F.col(f"`{c}`") for c in columns])
