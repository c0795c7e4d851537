"""Verification summaries, coverage and the integrity index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Added before a sum of weighted shares is rounded, so that binary noise does not decide a half.
TIE = 1e-9


def verification_summary(rows: DataFrame) -> DataFrame:
    s = F.col("status")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(s == k).alias(k) for k in ("verified", "likely", "needs_review", "not_found", "offline")],
        F.round(F.sum(F.when(s == "verified", 1.0).when(s == "likely", 0.5).otherwise(0.0)) / F.count(F.lit(1)) * 100 + TIE, 2).alias("integrity"),
    )


def concentration_and_diversity(rows: DataFrame) -> DataFrame:
    """Per document, from the shares of the authors (lists are cut at commas): concentration (1 - min(1, 5 HHI)) * 100 and diversity, entropy over ln k * 100; 100 and 0 without authors."""
    names = rows.select("doc_id", F.explode(F.transform(F.split(F.coalesce("author", F.lit("")), ","), lambda a: F.trim(a))).alias("author")).filter("author <> ''")
    counts = names.groupBy("doc_id", "author").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("doc_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum(F.col("c") * F.log("c")).alias("l"))
    hhi = F.col("q") / (F.col("n") * F.col("n"))
    entropy = F.log("n") - F.col("l") / F.col("n")
    top = F.when(F.col("k") > 1, F.log("k")).otherwise(F.lit(1.0))
    both = per.select("doc_id", F.round((F.lit(1.0) - F.least(F.lit(1.0), hhi * 5)) * 100, 2).alias("concentration"), F.round(entropy / top * 100, 2).alias("diversity"))
    return rows.select("doc_id").distinct().join(both, "doc_id", "left").select("doc_id", F.coalesce("concentration", F.lit(100.0)).alias("concentration"), F.coalesce("diversity", F.lit(0.0)).alias("diversity"))


def temporal(rows: DataFrame, current_year: int, window: int = 5) -> DataFrame:
    """Per document: balance min(1, span / 20) * 100 (50 below two references with a year), recency, and quality 0.6 recency + 0.4 balance."""
    y = F.col("year")
    per = rows.filter(y.isNotNull()).groupBy("doc_id").agg(
        F.when(F.count("year") < 2, 50.0).otherwise(F.least(F.lit(1.0), (F.max("year") - F.min("year")) / 20.0) * 100).alias("balance"),
        (F.avg(F.when(F.lit(current_year) - y <= window, 1.0).otherwise(0.0)) * 100).alias("recency"),
    )
    per = per.select("doc_id", F.round(F.col("balance") + TIE, 2).alias("balance"), F.round(F.col("recency") + TIE, 2).alias("recency"))
    per = per.withColumn("quality", F.round(F.col("recency") * 0.6 + F.col("balance") * 0.4 + TIE, 2))
    none = {"balance": 50.0, "recency": 0.0, "quality": 20.0}
    return rows.select("doc_id").distinct().join(per, "doc_id", "left").na.fill(none)


def category(score: Column) -> Column:
    """Name of a score's band."""
    return F.when(score >= 90, "Excellent").when(score >= 80, "Very Good").when(score >= 70, "Good").when(score >= 60, "Moderate").when(score >= 50, "Weak").otherwise("Poor")


#: States of a lookup that has not ended well; the index is withheld while a reference is in one.
OPEN_STATES = ("offline", "failed", "error", "queued", "pending")


def integrity_index(rows: DataFrame, current_year: int) -> DataFrame:
    """The index of each document: 0.35 integrity, 0.20 concentration, 0.20 diversity, 0.25 temporal quality.

    Withheld (null) while a row's publication status is unchecked, its lookup is open or it was not attempted; capped at 49, 59
    or 79 by an active retraction or withdrawal, a concern or a correction, which also name the category, as reinstatements do.
    """
    parts = verification_summary(rows).select("doc_id", "integrity").join(concentration_and_diversity(rows), "doc_id").join(temporal(rows, current_year).select("doc_id", "quality"), "doc_id")
    p = F.col("publication_status")
    flags = rows.groupBy("doc_id").agg(F.max(p.isin("retracted", "withdrawn")).alias("ret"), F.max(p == "expression_of_concern").alias("con"), F.max(p == "corrected").alias("cor"), F.max(p == "reinstated").alias("rei"), F.max((p == "unchecked") | F.col("status").isin(*OPEN_STATES) | ~F.col("attempted")).alias("open"))
    raw = F.round(F.col("integrity") * 0.35 + F.col("concentration") * 0.20 + F.col("diversity") * 0.20 + F.col("quality") * 0.25 + TIE, 2)
    cap = F.when(F.col("ret"), 49.0).when(F.col("con"), 59.0).when(F.col("cor"), 79.0).otherwise(100.0)
    score = F.when(F.col("open"), F.lit(None).cast("double")).otherwise(F.least(raw, cap))
    name = F.when(F.col("open"), "Incomplete Integrity Coverage").when(F.col("ret"), "Critical Review").when(F.col("con"), "Review Required").when(F.col("cor"), "Qualified").when(F.col("rei"), "Verified with History").otherwise(category(raw))
    return parts.join(flags, "doc_id").select("doc_id", raw.alias("raw_index"), score.alias("index"), name.alias("category"))


def coverage(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Expected, processed, matched and pending references of each document, and whether it is complete."""
    expected = refs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"))
    done = rows.groupBy("doc_id").agg(F.count_if(F.col("attempted")).alias("processed"), F.count_if(F.col("status").isin("verified", "likely") & F.col("attempted")).alias("matched"))
    joined = expected.join(done, "doc_id", "left").na.fill(0, ["processed", "matched"])
    return joined.select(
        "doc_id", "expected", "processed", "matched", F.greatest(F.col("expected") - F.col("processed"), F.lit(0)).alias("pending"),
        F.floor(F.coalesce(F.try_divide(F.col("processed") * 100, F.col("expected")), F.lit(0))).cast("bigint").alias("percentage"),
        F.when(F.col("processed") >= F.col("expected"), "completed").otherwise("incomplete").alias("state"),
    )


def occurrence_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs the k-th row of a key on the left with the k-th on the right; left rows without a partner stay."""
    k = lambda df, order: df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return k(left, left_order).join(k(right, right_order), [*keys, "__k"], "left").withColumnRenamed("__k", "occurrence")


def with_outcomes(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Every reference with its outcome; one without a result is offline."""
    out = refs.join(rows.select("doc_id", "ref_idx", "status"), ["doc_id", "ref_idx"], "left")
    return out.select("doc_id", "ref_idx", F.coalesce("status", F.lit("offline")).alias("status"), F.col("status").isNull().alias("missing_result"))
