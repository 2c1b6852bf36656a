"""URL filters: host and path rules, else boosted trees on what the URL looks like.

Features are columns of Spark expressions; the trees are Spark's own gradient-boosted
classifier, trained on a bounded sample of labelled URLs.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.common import about

#: Labelled URLs that the trees are trained on, and the hosts' smoothing weight.
SAMPLE_URLS, SMOOTH = 20_000, 5.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy",
            "longest_label", "parameters", "has_fragment", "vowel_ratio", "suffix2", "suffix3"]


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, null without one.

    A rule such as ``example.net/en/`` fits its host and the hosts below it, if the path
    starts with the rule's path (which begins with its first slash).
    """
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, slash, rest = rule.partition("/")
        here = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(slash + rest))
        fit = F.when(here, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def features(urls: DataFrame) -> DataFrame:
    """The rows with host, path and the lexical features, from a column ``url``; a null url looks like an empty one."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.regexp_extract(url, _PARTS, 3).alias("_query"))
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, "\\.")
    share = F.transform(F.array_distinct(F.split(host, "")), lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.length(host))
    entropy = F.when(F.length(host) > 0, F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))).otherwise(0.0)
    return rows.select(
        "*", F.length(url).cast("double").alias("length"), F.length(host).cast("double").alias("host_length"), F.length(path).cast("double").alias("path_length"),
        _count(path, "/").cast("double").alias("depth"), F.size(labels).cast("double").alias("labels"),
        _ratio(_count(url, "0123456789"), F.length(url)).alias("digit_ratio"), _count(host, "0123456789").cast("double").alias("host_digits"),
        _count(host, "-").cast("double").alias("hyphens"), entropy.alias("entropy"),
        F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)).cast("double").alias("longest_label"),
        (_count(F.col("_query"), "&") + (F.length("_query") > 1).cast("int")).cast("double").alias("parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"), _ratio(_count(host, "aeiou"), F.length(host)).alias("vowel_ratio"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("_s2"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".").alias("_s3")).drop("_query")


class UrlModel:
    """Trained trees with the label statistics of host suffixes."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame | None, prior: float):
        self.trees, self.suffixes, self.prior = trees, suffixes, prior

    def with_suffixes(self, rows: DataFrame) -> DataFrame:
        for n in ("2", "3"):
            known = self.suffixes.filter(F.col("kind") == n).select(F.col("suffix").alias(f"_s{n}"), F.col("rate").alias(f"suffix{n}"))
            rows = rows.join(known, f"_s{n}", "left").fillna({f"suffix{n}": self.prior})
        return rows


def train(labelled: DataFrame, sample: int = SAMPLE_URLS, trees: int = 20, depth: int = 4, seed: int = 3) -> UrlModel:
    """Trees from (url, label) rows, label 1 for URLs to block; rows with a null in either don't count.

    Some ``sample`` distinct URLs, taken by their hash, are used, each with its most frequent
    label (a mean of at least one half), so a hot URL counts once. Suffix statistics are
    smoothed rates within the sample. With fewer than two labels no tree is grown, and the
    only label is the verdict.
    """
    full = labelled.filter("url is not null and label is not null")
    urls = full.agg(F.approx_count_distinct("url")).first()[0]
    one = full.filter(about(sample, urls, F.col("url"), F.lit(seed))).groupBy("url").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    rows = features(one).persist()
    seen = rows.agg(F.avg("label").alias("p"), F.count_distinct("label").alias("n")).first()
    prior = seen.p or 0.0
    if seen.n < 2:
        rows.unpersist()
        return UrlModel(None, None, prior)
    pairs = rows.select("label", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(f"_s{n}").alias("suffix")) for n in ("2", "3")))).alias("s"))
    rates = pairs.groupBy("s.kind", "s.suffix").agg(((F.sum("label") + SMOOTH * prior) / (F.count(F.lit(1)) + SMOOTH)).alias("rate"))
    # at most two rows for each sampled URL
    suffixes = labelled.sparkSession.createDataFrame(rates.collect(), "kind string, suffix string, rate double")
    model = UrlModel(None, suffixes, prior)
    data = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(model.with_suffixes(rows)).select("_x", "label")
    model.trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed).fit(data)
    rows.unpersist()
    return model


def judge(urls: DataFrame, model: UrlModel, rules: list[tuple[str, str]]) -> DataFrame:
    """The rows' columns but clashing ones, with host, path, rule, verdict and block_score.

    The longest rule that fits decides; else the trees do. ``block_score`` is the trees'
    probability, whether used or not. Rows are judged one by one; null URLs have an empty
    host and path and the trees' verdict on an empty URL.
    """
    own = ["host", "path", "rule", "verdict", "block_score", "_query", "_s2", "_s3", "_x", "_raw", "_fit", "prediction", *FEATURES]
    rows = features(urls.drop(*own)) if model.trees is not None else urls.drop(*own).select(
        "*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keep = [c for c in urls.columns if c not in own]
    if model.trees is None:
        scored = rows.withColumn("block_score", F.lit(float(model.prior)))
    else:
        from pyspark.ml.functions import vector_to_array

        trees = model.trees.setProbabilityCol("_p").setRawPredictionCol("_raw").setPredictionCol("")
        scored = trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(model.with_suffixes(rows)))
        scored = scored.withColumn("block_score", vector_to_array("_p")[1])
    fit = scored.withColumn("_fit", rule_of(F.col("host"), F.col("path"), rules))
    return fit.select(*keep, "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(
        "_fit.verdict", F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).alias("verdict"), "block_score")
