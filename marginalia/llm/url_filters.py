"""URL filters by hashed expressions.

Each URL is expanded into host suffixes x path prefixes; the expressions meet the rules by an
equi-join on a short hash prefix, the full digest confirms, and the longest rule wins.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict. Repeated pages give a row each. A null id stays null. Rules with a null host, path
or verdict are ignored; of equal rules that differ in verdict, block wins. Columns beside id and url are
not read, so they may have any name. No pages or no rules: no rows, or the default verdict for all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import LOWER, UPPER

#: Hexadecimal digits of the short hash that expressions and rules are joined on (32 bits).
SHORT = 8


def split_url(url):
    """Columns host and path of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digested(df: DataFrame, expression: str) -> DataFrame:
    df = df.withColumn("__digest", F.sha2(F.col(expression), 256))
    return df.withColumn("__short", F.substring("__digest", 1, SHORT))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages judged by rules(host, path, verdict): id, host, path, rule, verdict.

    A rule fits its host and all subdomains when the url's path starts with the rule's path. Only suffix
    depths and prefix lengths that some rule has are expanded; these two small sets of numbers are all that
    reaches the driver. Catalyst broadcasts the rules when they are below its size threshold and otherwise
    shuffles both sides by the short hash, where adaptive execution splits a hot host.
    """
    ruled = (
        rules.select(F.translate("host", UPPER, LOWER).alias("__rh"), F.col("path").alias("__rp"), F.col("verdict").alias("__rv"))
        .na.drop()
        .withColumn("__rule", F.concat("__rh", "__rp"))
        .groupBy("__rule", "__rh", "__rp")
        .agg(F.max(F.col("__rv") == "block").alias("__block"), F.max("__rv").alias("__rv"))
        .withColumn("__rv", F.when(F.col("__block"), F.lit("block")).otherwise(F.col("__rv")))
    )
    shapes = ruled.select(F.size(F.split("__rh", r"\.")).alias("d"), F.length("__rp").alias("n")).agg(F.collect_set("d").alias("d"), F.collect_set("n").alias("n")).first()
    depths, lengths = sorted(shapes["d"] or [0]), sorted(shapes["n"] or [0])
    rule_side = _digested(ruled.select("__rule", "__rv", "__block"), "__rule").select(
        F.col("__short"), F.col("__digest").alias("__rule_digest"), "__rule", "__rv", "__block"
    )

    urls = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"))
    host, path = split_url(F.col("__url"))
    urls = urls.select(F.monotonically_increasing_id().alias("__row"), "__id", host.alias("__host"), path.alias("__path"))
    labels = F.split("__host", r"\.")
    suffixes = F.array_compact(
        F.transform(
            F.array(*[F.lit(d) for d in depths]),
            lambda d: F.when(d <= F.size(labels), F.array_join(F.slice(labels, F.greatest(F.size(labels) - d + 1, F.lit(1)), F.greatest(d, F.lit(0))), ".")),
        )
    )
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("__path")), lambda n: F.substring(F.col("__path"), F.lit(1), n)
    )
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    spread = _digested(urls.withColumn("__expression", F.explode_outer(expressions)), "__expression")
    hit = F.col("__digest") == F.col("__rule_digest")
    found = F.when(hit, F.struct(F.length("__rule").alias("n"), F.col("__rule").alias("rule"), F.col("__rv").alias("verdict")))
    return (
        spread.join(rule_side, "__short", "left")
        .groupBy("__row", "__id", "__host", "__path")
        .agg(F.max(found).alias("__best"))
        .select(
            F.col("__id").alias(id_col),
            F.col("__host").alias("host"),
            F.col("__path").alias("path"),
            F.col("__best.rule").alias("rule"),
            F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
        )
    )
