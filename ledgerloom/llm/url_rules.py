"""URL filtering by given rules and by mined association rules.

Given rules (verdict, host, path) judge the urls that they fit. These urls, with their
verdicts as labels, are the transactions that FP-growth mines: which combinations of url
tokens (host labels, path segments, query keys, scheme) imply a verdict. Rules below a
support or a confidence are pruned, and so are rules that a part of their tokens implies as
surely. The rest judge the other urls: an inverted index holds each rule under its rarest
token, a url looks up its tokens, and what it finds must be contained in it. The surest
rule decides, then the better supported, then allow. Without a rule a url is allowed.

Only built-in functions and Spark's own FP-growth are used. Defined cases: a null url, or one
without ``://``, has an empty host and path, no tokens, and is allowed; urls that repeat, and
rows with a null or repeated page_id, are judged each; without fitted urls no rule is mined;
an empty table gives no rows; columns other than ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stored

ALLOW, BLOCK = "allow", "block"
#: Verdict, host, start of the path.
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
SUPPORT = 0.01
CONFIDENCE = 0.8
_LABEL = "label="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows the path."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(after, "^[^/?#]*", 0)
    rest = F.substring(after, F.length(host) + 1, F.length(after))
    path = F.regexp_extract(rest, "^[^?#]*", 0)
    tail = F.substring(rest, F.length(path) + 1, F.length(rest))
    empty = F.lit("")
    return (F.when(has, F.translate(host, _UPPER, _LOWER)).otherwise(empty),
            F.when(has, path).otherwise(empty), F.when(has, tail).otherwise(empty))


def fitted_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null fields without one."""
    chosen = F.struct(F.lit(None).cast("string").alias("rule"),
                      F.lit(None).cast("string").alias("verdict"))
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"),
                                       F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(url: Column, host: Column, path: Column, tail: Column) -> Column:
    """Distinct tokens; path segments of digits count as one token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x))
    segments = F.transform(
        F.filter(F.split(path, "/"), lambda x: x != ""),
        lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "^[0-9]+", "0")))
    query = F.regexp_extract(tail, r"^\?([^#]*)", 1)
    keys = F.transform(
        F.filter(F.split(query, "&"), lambda x: x != ""),
        lambda x: F.concat(F.lit("query="), F.split(x, "=")[0]))
    scheme = F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1)))
    found = F.concat(F.array(scheme), labels, segments, keys)
    return F.when(host != "", F.array_distinct(found)) \
        .otherwise(F.array().cast("array<string>"))


def mined(labelled: DataFrame, support: float = SUPPORT,
          confidence: float = CONFIDENCE) -> DataFrame:
    """Pruned rules from ``tokens`` and ``verdict``: antecedent, verdict, confidence, support
    and key, the antecedent's rarest token."""
    spark = labelled.sparkSession
    schema = ("antecedent array<string>, verdict string, confidence double, support double, "
              "key string")
    transactions = labelled.select(F.concat(
        "tokens", F.array(F.concat(F.lit(_LABEL), F.col("verdict")))).alias("items"))
    if transactions.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence) \
        .fit(transactions)
    rules = stored(
        model.associationRules
        .where(F.element_at("consequent", 1).startswith(_LABEL))
        .where(~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
        .select(F.array_sort("antecedent").alias("antecedent"),
                F.substring(F.element_at("consequent", 1), F.lit(len(_LABEL) + 1), F.lit(9))
                .alias("verdict"), "confidence", "support"), "rules")
    # a rule is redundant if a part of its tokens implies the same as surely
    general = rules.select(
        F.element_at("antecedent", 1).alias("token"), F.col("antecedent").alias("part"),
        "verdict", F.col("confidence").alias("sure"))
    redundant = (
        rules.withColumn("token", F.explode("antecedent")).join(general, ["token", "verdict"])
        .where((F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence"))
               & (F.size(F.array_except("part", "antecedent")) == 0))
        .select("antecedent", "verdict").distinct()
    )
    kept = rules.join(redundant, ["antecedent", "verdict"], "left_anti")
    frequency = (model.freqItemsets.where(F.size("items") == 1)
                 .select(F.element_at("items", 1).alias("key"), "freq"))
    keyed = kept.withColumn("key", F.explode("antecedent")).join(frequency, "key")
    rarest = keyed.groupBy("antecedent", "verdict", "confidence", "support") \
        .agg(F.min_by("key", F.struct("freq", "key")).alias("key"))
    return stored(rarest.select("antecedent", "verdict", "confidence", "support", "key"), "rules")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
           support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict``, and ``mined`` (the tokens of the
    mined rule that decided)."""
    url = F.col("url")
    host, path, tail = parts(url)
    read = (
        pages.select("page_id", url, host.alias("host"), path.alias("path"), tail.alias("tail"))
        .select("page_id", "host", "path",
                fitted_rule(F.col("host"), F.col("path"), rules).alias("fitted"),
                tokens(url, F.col("host"), F.col("path"), F.col("tail")).alias("tokens"))
        .select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path",
                "fitted.rule", "fitted.verdict", "tokens")
    )
    read = stored(read, "urls")
    index = mined(read.where("rule IS NOT NULL"), support, confidence)
    matches = (
        read.where("rule IS NULL").select("row", "tokens", F.explode("tokens").alias("key"))
        .join(index.withColumnRenamed("verdict", "implied"), "key")
        .where(F.size(F.array_except("antecedent", "tokens")) == 0)
        .groupBy("row").agg(F.max_by(
            F.struct("implied", "antecedent"),
            F.struct("confidence", "support", F.col("implied") == ALLOW, "antecedent"))
            .alias("found"))
    )
    return read.join(matches, "row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", "found.implied", F.lit(ALLOW)).alias("verdict"),
        F.array_join("found.antecedent", " ").alias("mined"))
