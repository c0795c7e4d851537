"""Previews, suggestions, correction plans, tiers and certificates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def preview(rows: DataFrame, group: list[str], order: list[str], fraction: float = 0.25, most: int = 10) -> DataFrame:
    """The first quarter of each group's rows, at least one and at most most: the report's preview."""
    part = W.partitionBy(*group)
    take = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(part) * fraction)))
    return rows.withColumn("__take", take).withColumn("__rn", F.row_number().over(part.orderBy(*order))).filter("__rn <= __take").drop("__rn", "__take")


def round_robin(rows: DataFrame, scope: str, group: str, order: list[str], fraction: float = 0.25, most: int = 10) -> DataFrame:
    """A fair preview: groups of a scope take turns until a fraction of its rows, one at least and most at most, is shown."""
    turn = F.row_number().over(W.partitionBy(scope, group).orderBy(*order))
    place = F.row_number().over(W.partitionBy(scope).orderBy("turn", group))
    total = F.count(F.lit(1)).over(W.partitionBy(scope))
    budget = F.least(total, F.lit(most), F.greatest(F.lit(1), F.ceil(total * fraction)))
    marked = rows.withColumn("turn", turn).withColumn("budget", budget).filter(F.col("turn") <= F.col("budget"))
    return marked.withColumn("place", place).filter(F.col("place") <= F.col("budget"))


def best_suggestions(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per original the lowest rank, then the highest confidence, then the first."""
    order = W.partitionBy(*key).orderBy("rank", F.col("confidence").desc(), "idx")
    return rows.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def suggestion_stats(rows: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(c >= 0.85).alias("high"), F.count_if((c >= 0.70) & (c < 0.85)).alias("medium"), F.count_if(c < 0.70).alias("low"))


#: Priorities of claims by their canonical support, reasons that mark a guess, and kinds of fixes that have items of their own.
CLAIM_PRIORITY = {"mapping_incomplete": "critical", "weak_or_unclear": "important", "insufficient_evidence": "critical"}
GUESSES = ("may be a typo", "possible author-name variation", "unique reference year", "review before changing", "citation was not matched", "similar author")
OWN_ITEMS = ("missing_reference", "uncited_reference")
FIX_CATEGORIES = {"citations": "citation_formatting", "references": "reference_metadata"}
REVIEW_NOTE = r"(?i)^(?:review\s+(?:the\s+)?reference\s+manually|manual\s+review\s+required|verify\s+(?:this\s+)?reference\s+manually|check\s+(?:the\s+)?publisher\s+record)\b"


def claim_items(claims: DataFrame) -> DataFrame:
    """doc_id, category, priority of claims(doc_id, support) whose canonical support asks for work."""
    table = F.create_map(*[F.lit(x) for pair in CLAIM_PRIORITY.items() for x in pair])
    return claims.select("doc_id", F.lit("claim_support").alias("category"), F.try_element_at(table, F.col("support")).alias("priority")).filter("priority is not null")


def audit_items(audits: DataFrame) -> DataFrame:
    """Items of audited references(doc_id, accepted, title_similarity, missing, needs_formatting); missing is an array of fields.

    Metadata that was not accepted conflicts if its title is like the reference's at all, critically below 0.70. Apart from that a
    reference is incomplete, or else out of style. Null means false, 0 or nothing missing.
    """
    like, incomplete = F.coalesce("title_similarity", F.lit(0.0)), F.coalesce(F.size("missing"), F.lit(0)) > 0
    conflict = ~F.coalesce("accepted", F.lit(False)) & (like > 0)
    item = lambda category, priority: F.struct(F.lit(category).alias("category"), priority.alias("priority"))
    important = F.lit("important")
    found = F.array(
        F.when(conflict, item("reference_identity_conflict", F.when(like < 0.70, "critical").otherwise("important"))),
        F.when(incomplete, item("reference_incomplete", important)).when(F.coalesce("needs_formatting", F.lit(False)), item("reference_style", important)),
    )
    return audits.select("doc_id", F.explode(F.array_compact(found)).alias("i")).select("doc_id", "i.*")


def fix_items(fixes: DataFrame) -> DataFrame:
    """Items of suggested fixes(doc_id, idx, kind, original, suggested, issue_type, fix_type, reason, confidence), kind citations or references.

    A fix counts once for its category, original and suggestion, in any case and spacing, if it changes something, is sure to
    0.80 and no guess, no note to review and no kind with items of its own; important from 0.85 on. Without either text it is none.
    """
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    old, new, issue = F.lower(text("original")), F.lower(text("suggested")), F.lower(F.coalesce("issue_type", F.lit("")))
    guess = F.lower(F.coalesce("reason", F.lit(""))).rlike("|".join(GUESSES))
    own = issue.isin(*OWN_ITEMS) | F.endswith(issue, F.lit("_uncited_numbered_reference"))
    review = text("suggested").rlike(REVIEW_NOTE) | F.coalesce(F.col("fix_type") == "review_required", F.lit(False))
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))
    category = F.try_element_at(F.create_map(*[F.lit(x) for pair in FIX_CATEGORIES.items() for x in pair]), F.col("kind"))
    good = fixes.filter((old != "") & (new != "") & (old != new) & (sure >= 0.80) & ~guess & ~own & ~review).select("doc_id", category.alias("category"), old.alias("old"), new.alias("new"), sure.alias("sure"), F.coalesce("idx", F.lit(0)).alias("idx"))
    first = good.filter("category is not null").groupBy("doc_id", "category", "old", "new").agg(F.min_by("sure", "idx").alias("sure"))
    return first.select("doc_id", "category", F.when(F.col("sure") >= 0.85, "important").otherwise("optional").alias("priority"))


def finding_items(findings: DataFrame) -> DataFrame:
    """Items of findings on tables and figures(doc_id, finding, priority): those with an id, important where no priority is given."""
    named = findings.filter(F.coalesce("finding", F.lit("")) != "")
    return named.select("doc_id", F.lit("table_figure").alias("category"), F.coalesce(F.nullif("priority", F.lit("")), F.lit("important")).alias("priority"))


#: Items of a kind that are listed, signals of the writing review that are listed and those that other checks cover.
MOST_ITEMS, MOST_SIGNALS, OTHER_CHECKS = 200, 12, ("claim_without_nearby_citation", "possible_claim_needing_source_review")
#: Risks that only add to an item of the same reference, kinds of such items, and decisions that settle an item.
MERGED_RISKS, MERGED_INTO, DECIDED = ("metadata_not_found", "publication_status_unchecked"), ("source_verification", "reference_incomplete"), ("accepted", "rejected", "ignored", "resolved")
#: Kinds of items that are evidence to be resolved.
EVIDENCE_KINDS = (
    "missing_reference", "citation_needed", "source_verification", "claim_support", "reference_incomplete", "reference_identity_conflict", "uncited_reference",
    "source_risk", "table_figure", "reference_metadata", "reference_style", "citation_formatting", "citation_coach",
)


def numbered_items(rows: DataFrame, category: str, priority: Column | str, order: list, prefix: str = "", most: int | None = MOST_ITEMS) -> DataFrame:
    """doc_id, item_id, category, priority, ref_idx of the first rows of each document, numbered from 1 in their order."""
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    ref = F.col("ref_idx").cast("bigint") if "ref_idx" in rows.columns else F.lit(None).cast("bigint")
    made = rows.withColumn("__n", n)
    made = made if most is None else made.filter(F.col("__n") <= most)
    return made.select("doc_id", F.concat_ws("-", F.lit(prefix or category), F.col("__n").cast("string")).alias("item_id"), F.lit(category).alias("category"), (F.lit(priority) if isinstance(priority, str) else priority).alias("priority"), ref.alias("ref_idx"))


def claim_list(claims: DataFrame) -> DataFrame:
    """Items of claims(doc_id, idx, support), a list of its own for each kind of support that asks for work."""
    prefix = {"mapping_incomplete": "claim-mapping-incomplete", "weak_or_unclear": "claim-weak-support", "insufficient_evidence": "claim-insufficient-evidence"}
    return functools.reduce(DataFrame.unionByName, [numbered_items(claims.filter(F.col("support") == k), "claim_support", CLAIM_PRIORITY[k], ["idx"], name) for k, name in prefix.items()])


def verification_list(rows: DataFrame) -> DataFrame:
    """Items of rows(doc_id, ref_idx, canonical) that are not verified: critical where the identity is in conflict, all of them."""
    open_ = rows.filter(~F.col("canonical").isin("verified", "valid_but_not_digitally_indexed"))
    return numbered_items(open_, "source_verification", F.when(F.col("canonical") == "serious_identity_conflict", "critical").otherwise("important"), ["ref_idx"], most=None)


def audit_list(audits: DataFrame) -> DataFrame:
    """Items of audit_items with their references, named after them."""
    made = audits.select("ref_idx", F.col("doc_id").alias("__d"), F.struct("doc_id", "ref_idx").alias("doc_id"), "accepted", "title_similarity", "missing", "needs_formatting")
    items = audit_items(made)
    prefix = F.when(F.col("category") == "reference_identity_conflict", "reference-identity-conflict").when(F.col("category") == "reference_incomplete", "reference-incomplete").otherwise("reference-style")
    return items.select(F.col("doc_id.doc_id").alias("doc_id"), F.concat_ws("-", prefix, F.col("doc_id.ref_idx").cast("string")).alias("item_id"), "category", "priority", F.col("doc_id.ref_idx").cast("bigint").alias("ref_idx"))


def risk_list(risks: DataFrame, others: DataFrame) -> DataFrame:
    """Items of risks(doc_id, ref_idx, risk, priority), but for those that only add to an item of the same reference among others."""
    here = others.filter(F.col("category").isin(*MERGED_INTO) & F.col("ref_idx").isNotNull()).select("doc_id", "ref_idx", F.lit(True).alias("there")).distinct()
    left = risks.withColumn("ref_idx", F.col("ref_idx").cast("bigint")).join(here, ["doc_id", "ref_idx"], "left").filter(~(F.col("risk").isin(*MERGED_RISKS) & F.coalesce("there", F.lit(False))))
    key = F.substring(F.sha2(F.concat_ws("|", "risk", F.col("ref_idx").cast("string")), 256), 1, 16)
    return left.select("doc_id", F.concat(F.lit("source-risk-"), key).alias("item_id"), F.lit("source_risk").alias("category"), "priority", "ref_idx")


def voice_list(signals: DataFrame) -> DataFrame:
    """Items of the first signals(doc_id, idx, signal) of the writing review that no other check covers, named by their place among all."""
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))
    rows = signals.withColumn("__place", place).filter(~F.col("signal").isin(*OTHER_CHECKS))
    kept = rows.withColumn("__n", F.row_number().over(W.partitionBy("doc_id").orderBy("idx"))).filter(F.col("__n") <= MOST_SIGNALS)
    return kept.select("doc_id", F.concat(F.lit("voice-"), F.col("__place").cast("string")).alias("item_id"), F.lit("academic_voice").alias("category"), F.lit("optional").alias("priority"), F.lit(None).cast("bigint").alias("ref_idx"))


def decided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items with the decision recorded for each, pending where there is none."""
    return items.join(decisions.select("doc_id", "item_id", "decision"), ["doc_id", "item_id"], "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def listed(items: DataFrame) -> DataFrame:
    """items with their place in the plan: critical, important, optional, then by kind."""
    rank = F.coalesce(*[F.when(F.col("priority") == p, i) for i, p in enumerate(("critical", "important", "optional"))], F.lit(9))
    return items.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(rank, "category", "item_id")).cast("bigint"))


def pending(items: DataFrame) -> DataFrame:
    """doc_id, critical, important, optional, total, decided, evidence, ready: what of the items is still to do."""
    todo = ~F.col("decision").isin(*DECIDED)
    of = lambda p: F.count_if(todo & (F.col("priority") == p)).alias(p)
    out = items.groupBy("doc_id").agg(of("critical"), of("important"), of("optional"), F.count_if(todo).alias("total"), F.count_if(~todo).alias("decided"), F.count_if(todo & F.col("category").isin(*EVIDENCE_KINDS)).alias("evidence"))
    return out.withColumn("ready", (F.col("critical") == 0) & (F.col("important") <= 2))


def counted(*parts: DataFrame) -> DataFrame:
    """Items of several kinds, counted by document, category and priority."""
    return functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "category", "priority").agg(F.count(F.lit(1)).alias("n"))


def compare_revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Items resolved and new between two versions, never negative."""
    j = before.select("doc_id", "category", F.col("n").alias("b")).join(after.select("doc_id", "category", F.col("n").alias("a")), ["doc_id", "category"], "full").na.fill(0, ["a", "b"])
    return j.select("doc_id", "category", F.greatest(F.lit(0), F.col("b") - F.col("a")).alias("resolved"), F.greatest(F.lit(0), F.col("a") - F.col("b")).alias("added"))


#: Name, words, references and citations that a tier allows.
TIERS = (("article", 15_000, 100, 300), ("research_paper", 35_000, 200, 700), ("thesis", 75_000, 350, 1_400), ("phd", 120_000, 600, 2_400))


def recommended_tier(words: Column, references: Column, citations: Column) -> Column:
    """The first tier whose limits all fit, else custom_large; a word count of 0 was not measured and fits any."""
    out = F.lit("custom_large")
    for name, w, r, c in reversed(TIERS):
        out = F.when(((words <= 0) | (words <= w)) & (references <= r) & (citations <= c), name).otherwise(out)
    return out


def clearance(score: Column, critical: Column, moderate: Column, recency: Column, clean_list: Column) -> Column:
    """Decision of a certificate. clean_list: no uncited and no missing references, and every open one verified with evidence."""
    return (
        F.when(clean_list & (recency >= 60), "Provisional clearance")
        .when((score >= 85) & (critical == 0) & (moderate <= 5), "Clearance Recommended")
        .when((score >= 70) & (critical <= 5), "Conditional Clearance")
        .when((score >= 55) | (moderate > 0), "Limited Clearance")
        .otherwise("Revision Required")
    )
