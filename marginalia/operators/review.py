"""Review views: entitlements, audits, recommendations, recovery rows, contexts, status names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions.text import slug

#: Names of a verification status by its canonical form; any other name needs review by a person.
STATUS_NAMES = {
    "verified": ("verified", "matched", "valid", "confirmed", "exact_match", "verified_exact"),
    "verified_with_metadata_differences": ("likely", "verified_with_metadata_differences", "verified_with_differences", "metadata_difference", "metadata_differences", "metadata_mismatch"),
    "valid_but_not_digitally_indexed": ("valid_not_indexed", "valid_but_not_indexed", "not_digitally_indexed", "valid_offline_source", "manual_valid", "valid_but_not_digitally_indexed"),
    "possible_match_human_review": ("possible", "possible_match", "needs_review", "manual_review", "review_required", "source_needs_review", "ambiguous", "unverified", "possible_match_human_review"),
    "not_found": ("not_found", "metadata_not_found", "no_match", "no_record", "unmatched"),
    "lookup_failed": ("failed", "lookup_failed", "verification_failed", "offline", "error", "timeout", "timed_out", "unavailable", "service_unavailable", "unknown", ""),
    "serious_identity_conflict": ("identity_conflict", "reference_identity_conflict", "serious_identity_conflict", "doi_title_conflict", "title_author_conflict"),
}
#: Names of a claim's support by its canonical form; any other name stays as it is.
SUPPORT_NAMES = {
    "direct_support": ("strong", "strong_support", "direct_support", "supported", "verified_support"),
    "partial_support": ("moderate", "moderate_support", "related_evidence", "partial_support"),
    "weak_or_unclear": ("weak", "weak_support", "weak_or_unclear", "unclear", "source_needs_review", "unverified", "failed"),
    "mapping_incomplete": ("mapping_incomplete", "incomplete_mapping", "no_mapping", "no_source", "not_mapped", "unmapped", ""),
    "insufficient_evidence": ("insufficient_evidence", "insufficient", "no_support", "unsupported", "contradicted", "contradictory"),
}
#: States of a lookup as the service reports them.
LOOKUP_STATES = ("verified", "likely", "needs_review", "not_found", "offline")
#: Group of a correction item by its category, where the status does not decide.
EVIDENCE_GROUPS = {
    "missing_reference": "missing_references",
    "citation_needed": "unsupported_claims",
    "reference_incomplete": "incomplete_metadata",
    "reference_identity_conflict": "metadata_conflicts",
    "uncited_reference": "uncited_references",
    "source_risk": "source_safety",
    "table_figure": "table_figure_integrity",
    "reference_metadata": "other_corrections",
    "reference_style": "other_corrections",
    "citation_formatting": "other_corrections",
    "citation_coach": "other_corrections",
}


def _named(table: dict[str, tuple], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for canonical, names in table.items() for n in names for x in (n, canonical)]), key)


def canonical_status(status: Column) -> Column:
    """Canonical form of a verification status."""
    return F.coalesce(_named(STATUS_NAMES, slug(F.trim(F.coalesce(status, F.lit(""))))), F.lit("possible_match_human_review"))


def canonical_support(status: Column) -> Column:
    """Canonical form of a claim's support."""
    key = slug(F.trim(F.coalesce(status, F.lit(""))))
    return F.coalesce(_named(SUPPORT_NAMES, key), key)


def lookup_state(status: Column) -> Column:
    """A reported state, or needs_review for any other text."""
    key = F.replace(F.lower(F.trim(F.coalesce(status, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(key.isin(*LOOKUP_STATES), key).otherwise("needs_review")


def evidence_group(category: Column, status: Column) -> Column:
    """Group of a correction item; null for categories that have none."""
    v, c = canonical_status(status), canonical_support(status)
    source = F.when(v == "not_found", "references_not_found").when(v == "lookup_failed", "verification_lookup_failed").otherwise("unresolved_verification")
    claim = F.when(c == "mapping_incomplete", "incomplete_mappings").when(c == "weak_or_unclear", "weak_support").otherwise("unsupported_claims")
    table = F.create_map(*[F.lit(x) for pair in EVIDENCE_GROUPS.items() for x in pair])
    return F.when(category == "source_verification", source).when(category == "claim_support", claim).otherwise(F.try_element_at(table, category))


def evidence_workspace(items: DataFrame) -> DataFrame:
    """items(doc_id, item, category, status, decision) grouped: total, pending, resolved and the items of each group."""
    named = items.withColumn("group", evidence_group(F.col("category"), F.col("status"))).filter("group is not null")
    pending = F.coalesce(F.nullif(F.col("decision"), F.lit("")), F.lit("pending")) == "pending"
    return named.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("total"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("resolved"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))


def entitled(rows: DataFrame, paid: Column, hidden: list[str], scope: str, order: list[str], fraction: float = 0.25, most: int = 10) -> DataFrame:
    """All rows and columns of paid scopes; of others a preview of rows with hidden columns null."""
    place = F.row_number().over(W.partitionBy(scope).orderBy(*order))
    take = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(W.partitionBy(scope)) * fraction)))
    out = rows.withColumn("__paid", paid).withColumn("__rn", place).withColumn("__take", take).filter("__paid or __rn <= __take")
    return out.withColumns({c: F.when(F.col("__paid"), F.col(c)) for c in hidden}).drop("__paid", "__rn", "__take")


def reference_audit(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """Per document: references, those without an outcome, and those whose outcome needs work."""
    j = refs.join(rows.select("doc_id", "ref_idx", "status"), ["doc_id", "ref_idx"], "left")
    return j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("references"), F.count_if(F.col("status").isNull()).alias("unchecked"), F.count_if(~F.col("status").isin("verified", "likely")).alias("needs_work"))


def recommendation(recency: Column, total: Column, target: float = 70.0) -> Column:
    """What to do about the share of recent sources: how many more would reach the target."""
    percent = lambda c: F.bround(c, 0).cast("int").cast("string")
    more = (F.bround(F.lit(target) / 100 * total, 0) - F.bround(recency / 100 * total, 0)).cast("int")
    goal = str(round(target))
    return (
        F.when(total == 0, "No references available for analysis.")
        .when(recency >= target, F.concat(F.lit("Recency is strong ("), percent(recency), F.lit("% ≤5 years). Maintain balance with foundational studies.")))
        .when(more <= 0, F.concat(F.lit("Recency is acceptable ("), percent(recency), F.lit("% ≤5 years). Consider adding a few more recent sources.")))
        .otherwise(F.concat(F.lit("Add approximately "), more.cast("string"), F.lit(" recent source(s) (≤5 years) to improve scholarly relevance (current: "), percent(recency), F.lit(f"%, target: {goal}%).")))
    )


def verification_advice(score: Column, total: Column) -> Column:
    """What to do about the share of verified references."""
    percent = F.bround(score, 0).cast("int").cast("string")
    fifth = F.bround(total * 0.2, 0).cast("int").cast("string")
    return (
        F.when(score >= 80, "Verification rate is excellent. Continue maintaining high standards.")
        .when(score >= 60, F.concat(F.lit("Verification rate is good ("), percent, F.lit("%). Consider verifying "), fifth, F.lit(" more reference(s) to reach 80%.")))
        .when(score >= 40, F.concat(F.lit("Verification rate needs improvement ("), percent, F.lit("%). Run online verification for unverified references.")))
        .otherwise(F.concat(F.lit("Low verification rate ("), percent, F.lit("%). Strongly recommend running online verification for all references.")))
    )


def diversity_advice(score: Column) -> Column:
    """What to do about the spread of authors."""
    percent = F.bround(score, 0).cast("int").cast("string")
    return (
        F.when(score >= 70, "Excellent author diversity. Citations are well-distributed.")
        .when(score >= 50, F.concat(F.lit("Good author diversity ("), percent, F.lit("%). Consider citing from a broader range of research groups.")))
        .otherwise(F.concat(F.lit("Limited author diversity ("), percent, F.lit("%). Citation concentration is high. Expand to include more varied sources.")))
    )


def priorities(verification: Column, recency: Column, diversity: Column, balance: Column) -> Column:
    """Areas to improve first, in this order; empty where there are none."""
    areas = F.array_compact(F.array(F.when(verification < 60, "verification"), F.when(recency < 50, "recency"), F.when(diversity < 50, "diversity"), F.when(balance < 40, "temporal balance")))
    return F.when(F.size(areas) == 0, "").otherwise(F.concat(F.lit("Focus on improving: "), F.array_join(areas, ", ")))


def text_of_positions(index: DataFrame, most: int = 180) -> DataFrame:
    """Text from an inverted index(id, word, pos): the first most words by position, whatever positions are missing."""
    place = F.row_number().over(W.partitionBy("id").orderBy("pos", "word"))
    near = index.withColumn("__k", place).filter(F.col("__k") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("__k", "word")))
    return near.groupBy("id").agg(F.array_join(F.transform(ordered, lambda p: p["word"]), " ").alias("text"))


def context(text: Column, needle: Column, before: int = 20, after: int = 40) -> Column:
    """Code points around the first place of a needle; null where it is absent."""
    at = F.position(needle, text)
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.length(needle) + F.least(at - 1, F.lit(before)) + after))


def recovery_rows(rows: DataFrame, catalog: DataFrame, most: int = 3) -> DataFrame:
    """rows(doc_id, ref_idx, title, year) with up to most catalog entries of the same title, nearest years first; one fallback row where there is none.

    Entries of equal title and year differ by their id only, so the least ids of each stand for them all; what is nearest is
    found once for each title and year that rows ask for.
    """
    least = W.partitionBy("t", "y").orderBy("cand_id")
    c = catalog.select(F.col("title").alias("t"), F.col("year").alias("y"), "cand_id").withColumn("n", F.row_number().over(least)).filter(F.col("n") <= most).drop("n")
    asked = rows.select(F.col("title").alias("t"), F.col("year").alias("asked")).distinct()
    order = W.partitionBy("t", "asked").orderBy(F.abs(F.col("asked") - F.col("y")).asc_nulls_last(), "cand_id")
    near = asked.join(c, "t").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    found = rows.join(near, (F.col("title") == F.col("t")) & F.col("year").eqNullSafe(F.col("asked")), "left")
    return found.select("doc_id", "ref_idx", F.coalesce("rank", F.lit(0)).cast("bigint").alias("rank"), F.coalesce(F.col("cand_id").cast("string"), F.lit("manual_search")).alias("suggestion"))
