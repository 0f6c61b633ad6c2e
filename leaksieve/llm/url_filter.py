"""URL filter: host rules, and gradient-boosted trees on lexical features for what no rule covers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, ALLOW = "block", "allow"
#: Labelled URLs the trees are fitted on, those of smallest hash.
TRAINING = 20_000
#: Numbers that suffixes are hashed to, for their share of blocked URLs.
SUFFIXES = 1024
_FEATURES = (
    "length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "query_length", "labels", "hyphens",
    "fragment", "extension", "secure", "suffix", "domain",
)

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    A rule is written as host and path; it fits the host and its subdomains where the
    path starts with the rule's. Of rules equally long the first wins.
    """
    rule = verdict = F
    for name, says in sorted(rules, key=lambda r: -len(r[0])):
        at = name.index("/")
        fits = ((host == name[:at]) | host.endswith("." + name[:at])) & path.startswith(name[at:])
        rule, verdict = rule.when(fits, name), verdict.when(fits, says)
    if rule is F:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def _bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SUFFIXES)).cast("int")


def _entropy(text: Column) -> Column:
    """Of the characters' shares, in bits."""
    letters = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1))
    return F.aggregate(
        F.array_distinct(letters),
        F.lit(0.0),
        lambda a, c: a - F.when(c == "", 0.0).otherwise((F.size(F.filter(letters, lambda x: x == c)) / n) * F.log2(F.size(F.filter(letters, lambda x: x == c)) / n)),
    )


def _lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    count = lambda text, what: (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))).cast("double")
    return {
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda p: p != "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")).cast("double"),
        "query_length": F.length(query).cast("double"),
        "labels": count(host, ".") + F.when(host == "", 0.0).otherwise(1.0),
        "hyphens": count(host, "-"),
        "fragment": F.contains(url, F.lit("#")).cast("double"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
        "secure": F.startswith(url, F.lit("https:")).cast("double"),
    }


@dataclass
class UrlModel:
    """Trees, and the share of blocked URLs by suffix; ``only`` is the verdict where there was nothing to learn."""

    trees: GBTClassificationModel | None
    suffix: list[float]
    domain: list[float]
    only: str = ALLOW


def _shares(labelled: DataFrame, column: str) -> list[float]:
    rows = labelled.groupBy(column).agg(F.sum("label"), F.count("*")).collect()
    shares = [0.5] * SUFFIXES
    for bucket, blocked, n in rows:
        shares[bucket] = (blocked + 1.0) / (n + 2.0)
    return shares


def _with_features(urls: DataFrame, suffix: list[float], domain: list[float]) -> DataFrame:
    named = urls.withColumns(_lexical(F.col("url"), F.col("host"), F.col("path")))
    table = lambda shares: F.array(*[F.lit(s) for s in shares])
    return named.withColumn("suffix", F.get(table(suffix), F.col("suffix_at"))).withColumn(
        "domain", F.get(table(domain), F.col("domain_at"))
    )


def _split(urls: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    url = F.col("url")
    parts = urls.select(*keep, "url", host_of(url).alias("host"), path_of(url).alias("path"))
    host = F.col("host")
    return parts.withColumn("suffix_at", _bucket(_suffix(host, 1))).withColumn("domain_at", _bucket(_suffix(host, 2)))


def train(urls: DataFrame, limit: int = TRAINING, trees: int = 20, depth: int = 4) -> UrlModel:
    """Gradient-boosted trees on labelled URLs (``url``, ``verdict``); rows without a verdict are left out.

    Suffix shares are counted over all labelled rows, in 1,024 hashed classes each for
    the last label and the last two. The trees see at most ``limit`` different URLs,
    those of smallest hash.
    """
    labelled = urls.where("verdict is not null")
    parts = _split(labelled, ["verdict"]).withColumn("label", (F.col("verdict") == BLOCK).cast("double"))
    suffix, domain = _shares(parts, "suffix_at"), _shares(parts, "domain_at")
    chosen = (
        parts.groupBy("url", "host", "path", "suffix_at", "domain_at").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("url"), "url").limit(limit)
    )
    rows = _with_features(chosen, suffix, domain).select("label", *_FEATURES).repartition(1).persist()
    try:
        labels = {r[0] for r in rows.select("label").distinct().collect()}
        if len(labels) < 2:
            return UrlModel(None, suffix, domain, BLOCK if labels == {1.0} else ALLOW)
        vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(rows)
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, stepSize=0.2).fit(vectors)
    finally:
        rows.unpersist()
    return UrlModel(model, suffix, domain)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], model: UrlModel) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    ``verdict`` is that of the longest rule that fits, else the trees'; ``score`` is
    their chance of a block (null where a single verdict was all there was to learn). A
    null url, or one without ``://``, has an empty host and path, fits no rule and is
    judged by the trees like any other. No shuffle, no Python; other columns are not
    looked at.
    """
    parts = _split(pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url")), ["page_id"])
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    known = parts.withColumns({"rule": rule, "says": says})
    if model.trees is None:
        score, opinion = F.lit(None).cast("double"), F.lit(model.only)
        judged = known
    else:
        featured = _with_features(known, model.suffix, model.domain)
        vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(featured)
        judged = model.trees.transform(vectors)
        score = F.get(vector_to_array("probability"), F.lit(1))
        opinion = F.when(F.col("prediction") == 1.0, BLOCK).otherwise(ALLOW)
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", opinion).alias("verdict"), score.alias("score"))


def label(urls: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``url, verdict`` of the URLs that a rule covers."""
    _, says = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    return urls.select(F.col("url").alias("url"), says.alias("verdict")).where("verdict is not null")
