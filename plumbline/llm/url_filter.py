"""URL filter: host rules first, then logistic regression on hashed n-grams.

The features are character n-grams of the host and of the path, hashed to a
fixed number of buckets.  The model is trained by full-batch gradient descent,
one aggregation a step, on a labelled URL table of bounded size; its ``DIM`` + 1
weights are an array that every row looks its features up in, so pages are
judged in their scan, without a join or a shuffle.  DataFrame functions only.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no
rule and has no n-gram but the edge marks; the model still judges it.  Repeated
rows get equal verdicts; a null id is kept as it is.  A score of exactly a half
allows.  A URL of any length is judged by all its n-grams.  Extra columns are not
read, so none can clash.  An empty labelled table, or one of a single class,
gives a model that answers with the class it saw (allow where there is none).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.kit import constant_array
from plumbline.storage import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DIM = 4096  #: hash buckets: the bound of the weight table
GRAM = 4  #: characters in an n-gram
TRAIN_ROWS = 2000  #: most labelled URLs used for the fit, half of each class
STEPS = 24
RATE = 40.0
RIDGE = 1e-4


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path up to the query or fragment; else empty."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else nulls; ties go to the smaller text."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(text: Column, kind: str) -> Column:
    """Bucket numbers of the text's character n-grams; ``kind`` keeps host and path apart."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(marked) - (GRAM - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), marked.substr(i, F.lit(GRAM))), F.lit(DIM)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of a URL; the last one, ``DIM``, is the bias."""
    return F.array_distinct(F.concat(F.array(F.lit(DIM)), grams(host, "h"), grams(path, "p")))


def bounded_sample(labelled: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """At most ``most`` / 2 distinct URLs of each class, those of smallest hash: (url, label)."""
    distinct = labelled.where("url is not null").groupBy("url").agg(F.max("label").alias("label"))
    order = [F.xxhash64("url"), F.col("url")]
    return distinct.where("label = 1").orderBy(*order).limit(most // 2).unionByName(distinct.where("label = 0").orderBy(*order).limit(most // 2))


def _score(fs: Column, weights: list[float]) -> Column:
    """The model's probability of ``block``."""
    table = constant_array(weights)
    total = F.aggregate(fs, F.lit(0.0), lambda z, f: z + F.get(table, f))
    return 1 / (1 + F.exp(-total / F.sqrt(F.size(fs))))


def fit(labelled: DataFrame) -> list[float]:
    """``DIM`` + 1 weights from a labelled table (url, label: 1 block, 0 allow) of bounded size."""
    host, path = host_and_path(F.col("url"))
    rows = written(labelled.select(F.col("label").cast("double").alias("y"), features(host, path).alias("fs")).where("y is not null"), "url-train")
    n, weights = max(1, rows.count()), [0.0] * (DIM + 1)
    for _ in range(STEPS):
        error = (F.col("y") - _score(F.col("fs"), weights)) / F.sqrt(F.size("fs"))
        slopes = rows.select(F.explode("fs").alias("feature"), error.alias("e")).groupBy("feature").agg(F.sum("e").alias("slope"))
        for feature, slope in slopes.collect():
            weights[feature] += RATE * (slope / n - RIDGE * weights[feature])
    return weights


def judge(pages: DataFrame, rules: list[Rule], weights: list[float], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict and, where no rule decides, the model's score of every row."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    score = F.when(F.col("r.verdict").isNull(), _score(features(F.col("host"), F.col("path")), weights))
    return rows.withColumn("score", score).select(
        id_col, "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )
