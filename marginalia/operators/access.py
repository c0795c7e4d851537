"""Purchases, runs and access: joins over commerce tables, retention, selection of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def valid(now: Column) -> Column:
    """Paid or active and not expired."""
    return F.col("status").isin("paid", "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def kept_content() -> Column:
    """Jobs whose content and result were not deleted."""
    return ~F.coalesce("content_deleted", F.lit(False)) & ~F.coalesce("result_deleted", F.lit(False))


def access(purchases: DataFrame, runs: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Runs of valid purchases whose job is complete and still has its content."""
    ok = purchases.filter(valid(now)).select("purchase_id", "account_id")
    done = jobs.filter((F.col("status") == "completed") & kept_content()).select("job_id")
    return runs.join(ok, "purchase_id").join(done, "job_id").select("purchase_id", "account_id", "job_id")


def latest_by_either(purchases: DataFrame, runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted job the newest purchase that was made for it or has run it: the disjunction as a union of two equi-joins."""
    direct = purchases.select("purchase_id", F.col("preview_job_id").alias("job_id"), "created_at")
    run = runs.join(purchases.select("purchase_id", "created_at"), "purchase_id").select("purchase_id", "job_id", "created_at")
    both = direct.unionByName(run).join(wanted.select("job_id").distinct(), "job_id")
    return both.groupBy("job_id").agg(F.max(F.struct("created_at", "purchase_id")).alias("b")).select("job_id", F.col("b.purchase_id").alias("purchase_id"))


def retained(rows: DataFrame, column: str, cutoff: Column) -> DataFrame:
    """Rows newer than a cutoff: what remains after a deletion by age."""
    return rows.filter(F.col(column) >= cutoff)


def work_selection(kinds: list[tuple[str, DataFrame]], limit: int, scope: str = "doc_id") -> DataFrame:
    """The first limit rows of each scope over several kinds of rows(scope, idx), kinds in the order given."""
    out = None
    for rank, (name, rows) in enumerate(kinds):
        part = rows.select(scope, "idx", F.lit(name).alias("kind"), F.lit(rank).alias("__rank"))
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(W.partitionBy(scope).orderBy("__rank", "idx"))
    return out.withColumn("__rn", place).filter(F.col("__rn") <= limit).select(scope, "kind", "idx")


def capped_by_type(rows: DataFrame, scope: str, kind: str, order: list[str], per_kind: int, most: int) -> DataFrame:
    """At most per_kind rows of each kind and most in all, of each scope."""
    first = rows.withColumn("__k", F.row_number().over(W.partitionBy(scope, kind).orderBy(*order))).filter(F.col("__k") <= per_kind)
    return first.withColumn("__n", F.row_number().over(W.partitionBy(scope).orderBy(*order))).filter(F.col("__n") <= most).drop("__k", "__n")


def trusted_lookup(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Outcome of each reference by its key: trusted rows before others, the first of each."""
    rank = F.when(F.col("status").isin("verified", "likely"), 0).otherwise(1)
    best = rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "ref_idx", "status")).alias("b"))
    return refs.join(best, "key", "left").select(*[refs[c] for c in refs.columns], F.coalesce("b.status", F.lit("unknown")).alias("status"))


def page_estimates(paragraphs: DataFrame, per_page: int = 500) -> DataFrame:
    """paragraphs(doc_id, para_idx, words) with the page they stand on by the words of the paragraphs before."""
    before = F.coalesce(F.sum("words").over(W.partitionBy("doc_id").orderBy("para_idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return paragraphs.withColumn("page", (F.floor(before / per_page) + 1).cast("bigint"))


def topic_profile(texts: DataFrame, id_col: str, text_col: str, limit: int = 24) -> DataFrame:
    """The most frequent words of four letters or more of each document."""
    w = texts.select(id_col, F.explode(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), F.lit(0))).alias("term")).filter(F.length("term") >= 4)
    counts = w.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("__rn", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("n"), "term"))).filter(F.col("__rn") <= limit).drop("__rn")


def repeated_openings(sentences: DataFrame) -> DataFrame:
    """sentences(doc_id, para_idx, sentence): first three words that open two sentences of a paragraph or more."""
    opening = F.array_join(F.slice(F.regexp_extract_all(F.lower("sentence"), F.lit("[a-z']+"), F.lit(0)), 1, 3), " ")
    return sentences.withColumn("opening", opening).filter("opening <> ''").groupBy("doc_id", "para_idx", "opening").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


def shared_hashes(a: DataFrame, b: DataFrame) -> DataFrame:
    """a(a_id, hashes) against b(b_id, hashes): shared hashes of every pair that shares one, by an equi-join on the hash."""
    x = a.select("a_id", F.explode(F.array_distinct("hashes")).alias("h"))
    y = b.select("b_id", F.explode(F.array_distinct("hashes")).alias("h"))
    return x.join(y, "h").groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))
