"""URL verdicts: allow and block rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted once on a small labelled table of URLs with Spark's
logistic regression; scoring is an expression: the hashed n-grams of a URL pick
weights from one literal array.

Edge cases: a null URL, or one without `://`, has an empty host and path, fits
no rule and gets the model's verdict on empty strings, which is the intercept.
Long URLs are scored whole. Repeated rows get the same verdict, an empty table
gives no rows, other columns stay. Labelled rows with a null URL or label are
left out; with one label only, that label is the verdict for all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import beside, double_array, let, lower_ascii

#: Fixed rules of the contract: verdict and pattern, host before the first slash, path from it on.
RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
#: The labelled URL table to train from: words of unwanted hosts, and plain ones.
UNWANTED = (
    "casino", "poker", "roulette", "slots", "jackpot", "betting", "bets", "gambling", "lottery", "bingo", "prizes", "pills", "viagra",
    "pharmacy-deal", "weight-loss", "diet-pills", "adult", "xxx", "porn", "sex-cams", "hot-singles", "dating", "escort-girls", "nude",
    "adserver", "ads", "popup-ads", "tracker", "clickbait", "spam", "link-farm", "free-money", "payday-loan", "credit-cash", "easy-loans",
    "phishing-login", "verify-account", "malware", "warez", "torrent-crack", "keygen", "prize-winner",
)
PLAIN = (
    "news", "science", "library", "museum", "weather", "garden", "history", "school", "physics", "cooking", "travel", "city", "forum",
    "docs", "wiki", "wordle", "recipes", "math", "health", "sports", "music", "theatre", "university", "journal", "letters", "maps",
    "nathan", "jonathan", "tartan", "station", "nation", "theory", "anthem", "other", "weathered", "inlander", "thousand", "ethereal",
    "downloads", "beads", "leads-crm", "roads-traffic", "threads", "essex", "camshaft", "sextant", "analysis", "shop", "hotel", "bank",
    "farmers", "village", "notation", "rations", "heather", "northern", "entire", "hesitant", "restore", "theodore", "tenor", "orient",
)
#: What stands around a word in a host name, the same for both labels.
AROUND = ("{}", "best-{}", "my{}", "{}-online", "{}-club")
PREFIXES = ("", "www.", "blog.", "m.")
PATHS = ("/en/1203", "/fr/88.html", "/de/4410/", "/es/17", "/", "/en/9?page=2")
ENDS = (".example.com", ".example.net", ".example.org")
BUCKETS = 32768


def labelled_names() -> list[tuple[str, int]]:
    """Host names with their label, every word in all of its surroundings."""
    return [(around.format(w), label) for label, words in ((1, UNWANTED), (0, PLAIN)) for w in words for around in AROUND]


def labelled_urls(spark: SparkSession, names: Sequence[tuple[str, int]] | None = None) -> DataFrame:
    """The small labelled table: every name under a few prefixes, ends and paths."""
    rows = []
    for k, (name, label) in enumerate(labelled_names() if names is None else names):
        for j, prefix in enumerate(PREFIXES):
            end, path = ENDS[(k + j) % len(ENDS)], PATHS[(k + 2 * j) % len(PATHS)]
            rows.append((f"https://{prefix}{name}{end}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def parts(url: Column) -> Column:
    """Struct of host and path. Both are empty without a `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.struct(lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)).alias("host"), path.alias("path"))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null; of equally long ones the first in the text order."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


def ngram_buckets(host: Column, path: Column, sizes: Sequence[int] = (3, 4, 5), buckets: int = BUCKETS) -> Column:
    """Distinct hash buckets of the character n-grams, host and path told apart by a mark.

    Bucket 0 is kept for the intercept and never drawn.
    """

    def grams(text: Column, mark: str) -> list[Column]:
        padded = F.concat(F.lit("^"), text, F.lit("$"))

        def of(n: int) -> Column:
            last = F.length(padded) - n + 1
            starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(padded, i, F.lit(n))))

        return [of(n) for n in sizes]

    every = F.concat(*grams(host, "h"), *grams(path, "p"))
    return F.array_distinct(F.transform(every, lambda g: (F.pmod(F.xxhash64(g), F.lit(buckets - 1)) + 1).cast("int")))


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    intercept: float

    def probability(self, buckets: Column) -> Column:
        """Of block. The n-grams' weights are averaged over the root of their number, as in training."""

        def of(found: Column, weights: Column) -> Column:
            total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
            return 1 / (1 + F.exp(-(total / F.sqrt(F.greatest(F.size(found), F.lit(1))) + F.lit(self.intercept))))

        return let(buckets, lambda found: of(found, double_array(self.weights)))


def fit(labelled: DataFrame, url: str = "url", label: str = "label", regularisation: float = 0.0003) -> Model:
    """Fits on a labelled URL table, 1 is block. The table must be small: it is a training sample, not the corpus."""
    clean = labelled.filter(F.col(url).isNotNull() & F.col(label).isNotNull())
    split = clean.select(F.col(label).cast("double").alias("label"), parts(F.col(url)).alias("p"))
    tokens = split.select("label", F.transform(ngram_buckets(F.col("p.host"), F.col("p.path")), lambda b: b.cast("string")).alias("grams"))
    seen = [r[0] for r in tokens.select("label").distinct().collect()]
    if len(seen) < 2:
        return Model((0.0,) * BUCKETS, 30.0 if seen == [1.0] else -30.0)
    vocabulary = [str(b) for b in range(BUCKETS)]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="counts")
    vectors = counter.transform(tokens)
    # each row gets unit length, so long URLs do not weigh more
    scaled = Normalizer(p=2.0, inputCol="counts", outputCol="features").transform(vectors)
    fitted = LogisticRegression(regParam=regularisation, maxIter=60, standardization=False).fit(scaled)
    return Model(tuple(round(float(w), 9) for w in fitted.coefficients.toArray()), round(float(fitted.intercept), 9))


def judge(pages: DataFrame, model: Model, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, out: str = "_url") -> DataFrame:
    """Adds a struct: host, path, rule, verdict and the model's probability of block."""

    def of(p: Column) -> Column:
        probability = model.probability(ngram_buckets(p["host"], p["path"]))
        both = F.struct(rule_of(p["host"], p["path"], rules).alias("r"), probability.alias("p_block"))
        return let(
            both,
            lambda b: F.struct(
                p["host"].alias("host"), p["path"].alias("path"), b["r"]["rule"].alias("rule"),
                F.coalesce(b["r"]["verdict"], F.when(b["p_block"] > threshold, "block").otherwise("allow")).alias("verdict"),
                b["p_block"].alias("p_block"),
            ),
        )

    return beside(pages, url, lambda d: d.withColumn("_out", let(parts(F.col("_t")), of)), {"_out": out})
