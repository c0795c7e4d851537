"""Citations against references: numeric and author-year joins, missing and uncited sides, near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def numbered(refs: DataFrame) -> DataFrame:
    """One reference for each (doc_id, num): the last one given, as later entries replace earlier ones."""
    return refs.groupBy("doc_id", "num").agg(F.max("ref_idx").alias("ref_idx"))


def reconcile_numeric(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, pos, num, ref_idx, status: every citation with its reference, or missing."""
    joined = cites.join(numbered(refs), ["doc_id", "num"], "left")
    return joined.select("doc_id", "pos", "num", "ref_idx", F.when(F.col("ref_idx").isNull(), "missing").otherwise("matched").alias("status"))


def missing_citations(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """Cited numbers without a reference, with their count and first position."""
    lost = cites.join(refs, ["doc_id", "num"], "left_anti")
    return lost.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("count_in_text"), F.min("pos").alias("first_pos"))


def uncited_references(cites: DataFrame, refs: DataFrame) -> DataFrame:
    return refs.join(cites, ["doc_id", "num"], "left_anti").select("doc_id", "ref_idx", "num")


def times_cited(cites: DataFrame, refs: DataFrame, sample: int = 6) -> DataFrame:
    """How often each reference is cited, and its first citing positions. Counts come first, so a hot reference keeps a sample only."""
    counts = cites.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("doc_id", "num").orderBy("pos")
    firsts = cites.select("doc_id", "num", "pos").distinct().withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= sample)
    firsts = firsts.groupBy("doc_id", "num").agg(F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("cited_by"))
    out = refs.join(counts, ["doc_id", "num"], "left").join(firsts, ["doc_id", "num"], "left")
    return out.select("doc_id", "ref_idx", F.coalesce("n", F.lit(0)).alias("times_cited"), F.coalesce("cited_by", F.lit("")).alias("cited_by"))


def match_summary(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """Per document: distinct cited numbers, matched, missing, uncited, references and the match rate in percent.

    One shuffle by (doc_id, num): both sides are tagged and folded together, so no join is needed.
    """
    tagged = cites.select("doc_id", "num", F.lit(1).alias("c"), F.lit(0).alias("r")).unionByName(refs.select("doc_id", "num", F.lit(0).alias("c"), F.lit(1).alias("r")))
    keys = tagged.groupBy("doc_id", "num").agg(F.sum("c").alias("c"), F.max("r").alias("r"))
    out = keys.groupBy("doc_id").agg(
        F.sum("c").alias("citations"), F.count_if(F.col("c") > 0).alias("distinct_cited"), F.count_if((F.col("c") > 0) & (F.col("r") > 0)).alias("matched"),
        F.count_if((F.col("c") > 0) & (F.col("r") == 0)).alias("missing"), F.count_if((F.col("c") == 0) & (F.col("r") > 0)).alias("uncited"), F.count_if(F.col("r") > 0).alias("references"),
    )
    rate = F.round(F.coalesce(F.try_divide(F.col("matched") * F.lit(100.0), F.col("distinct_cited")), F.lit(0.0)), 4)
    return out.withColumn("match_rate", rate)


def alias_keys(fields: DataFrame) -> DataFrame:
    """doc_id, alias, ref_idx: the reference that answers to an author|year key; preferred aliases take the last one, others the first."""
    own = fields.select("doc_id", "ref_idx", F.concat_ws("|", "author", F.col("year").cast("string")).alias("alias"), F.lit(False).alias("prefer"))
    short = fields.select("doc_id", "ref_idx", F.concat_ws("|", F.substring("author", 1, 6), F.col("year").cast("string")).alias("alias"), F.lit(True).alias("prefer"))
    return own.unionByName(short).groupBy("doc_id", "alias").agg(
        F.coalesce(F.max(F.when(F.col("prefer"), F.col("ref_idx"))), F.min("ref_idx")).alias("ref_idx")
    )


def reconcile_author_year(cites: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, author, year, n, n_candidates, ref_idx, flag for every distinct author-year citation.

    An author-year key shared by several references credits the first and is flagged ambiguous; a key without a
    reference is missing.
    """
    keys = cites.groupBy("doc_id", "author", "year").agg(F.count(F.lit(1)).alias("n"))
    found = fields.groupBy("doc_id", "author", "year").agg(F.count(F.lit(1)).alias("k"), F.min("ref_idx").alias("ref_idx"))
    flag = F.when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "ambiguous_same_author_year").otherwise("matched")
    return keys.join(found, ["doc_id", "author", "year"], "left").select("doc_id", "author", "year", "n", F.coalesce("k", F.lit(0)).alias("n_candidates"), "ref_idx", flag.alias("flag"))


def other_year(missing: DataFrame, fields: DataFrame, span: int = 5) -> DataFrame:
    """Missing author-year citations with the nearest reference of the same author within span years: score 100 less up to 24."""
    pairs = missing.alias("m").join(fields.alias("f"), (F.col("m.doc_id") == F.col("f.doc_id")) & (F.col("m.author") == F.col("f.author")) & (F.abs(F.col("m.year") - F.col("f.year")) <= span))
    gap = F.abs(F.col("m.year") - F.col("f.year"))
    best = pairs.groupBy("m.doc_id", "m.author", "m.year").agg(F.min(F.struct(gap.alias("gap"), F.col("f.ref_idx").alias("ref_idx"))).alias("b"))
    return best.select("doc_id", "author", "year", F.col("b.ref_idx").alias("ref_idx"), (F.lit(100) - F.least(F.col("b.gap") * 4, F.lit(24))).cast("int").alias("score"))


def split_missing(missing: DataFrame, possible: DataFrame) -> DataFrame:
    """Missing citations told apart by whether a possible match exists."""
    marked = missing.join(possible.select("doc_id", "author", "year", F.lit(True).alias("p")), ["doc_id", "author", "year"], "left")
    return marked.groupBy("doc_id").agg(F.count_if(F.col("p")).alias("possible"), F.count_if(F.col("p").isNull()).alias("missing"))


def reference_to_intext(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """Full outer view of references and cited numbers, cited ones first and most cited first."""
    counts = cites.groupBy("doc_id", "num").agg(F.count(F.lit(1)).alias("times"))
    return refs.select("doc_id", "num", "ref_idx").join(counts, ["doc_id", "num"], "full").select("doc_id", "num", "ref_idx", F.coalesce("times", F.lit(0)).alias("times"))
