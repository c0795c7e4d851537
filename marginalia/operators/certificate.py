"""Certificate counts: verification with manual decisions, claims, sentences that need citations, risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.plan import clearance

#: Support states of claims that count as critical and as moderate, and states of sources that add a moderate one.
CLAIM_CRITICAL = ("insufficient_evidence", "no_evidence_found", "no_source_found", "source_not_found", "matched_source_not_available")
CLAIM_MODERATE = ("weak_or_unclear", "related_evidence", "source_needs_review", "manual_review_required", "insufficient_title_overlap", "title_overlap_review_required")
SOURCE_MODERATE = ("needs_review", "not_found", "offline", "manual_not_verified")
CLAIM_STATES = ("strong_support", "moderate_support", "related_evidence", "weak_or_unclear", "insufficient_evidence", "no_evidence_found")
#: States that ask for a manual decision.
MANUAL_REQUIRED = ("needs_review", "not_found", "offline")


def verification_counts(rows: DataFrame) -> DataFrame:
    """Per document: lookups by state, manual decisions, and references that need a decision without one that has evidence.

    rows(doc_id, key, status, manual_decision, evidence_url); a reference is its key, so repeated keys need one decision.
    """
    s, d = F.lower("status"), F.lower(F.coalesce("manual_decision", F.lit("")))
    keyed = rows.withColumn("__required", s.isin(*MANUAL_REQUIRED)).withColumn("__cleared", (d == "manual_verified") & (F.coalesce("evidence_url", F.lit("")) != ""))
    keys = keyed.groupBy("doc_id", "key").agg(F.max("__required").alias("r"), F.max("__cleared").alias("c")).groupBy("doc_id")
    keys = keys.agg(F.count_if("r").alias("manual_required"), F.count_if(F.col("r") & F.col("c")).alias("manual_cleared"), F.count_if(F.col("r") & ~F.col("c")).alias("manual_unresolved"))
    counts = keyed.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(s == "verified").alias("verified"), F.count_if(s == "likely").alias("likely"), F.count_if(s == "needs_review").alias("needs_review"), F.count_if(s == "not_found").alias("not_found"),
        F.count_if(s == "offline").alias("offline"), *[F.count_if(d == k).alias(k) for k in ("manual_verified", "manual_not_verified", "not_indexed_but_plausible", "keep_needs_review")],
    )
    return counts.join(keys, "doc_id")


def claim_counts(rows: DataFrame) -> DataFrame:
    """rows(doc_id, support_status, status): claims by state, issues, critical and moderate ones; an uncertain source adds a moderate issue of its own."""
    s, v = F.lower(F.coalesce("support_status", F.lit("offline"))), F.lower(F.coalesce("status", F.lit("")))
    n = lambda cond: F.count_if(cond)
    critical, moderate, source = s.isin(*CLAIM_CRITICAL), s.isin(*CLAIM_MODERATE), v.isin(*SOURCE_MODERATE)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), *[n(s == k).alias(k) for k in CLAIM_STATES], (n(critical) + n(moderate) + n(source)).alias("issues"), n(critical).alias("critical"), (n(moderate) + n(source)).alias("moderate")
    )


def needed_counts(rows: DataFrame) -> DataFrame:
    """rows(doc_id, priority) by priority: high or critical, low or minor, all others medium."""
    p = F.lower(F.trim(F.coalesce("priority", F.lit("medium"))))
    high, low = p.isin("high", "critical"), p.isin("low", "minor")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(high).alias("high"), F.count_if(~high & ~low).alias("medium"), F.count_if(low).alias("low"))


def certificates(scores: DataFrame, lists: DataFrame, verification: DataFrame, claims: DataFrame, needed: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """Risks and decision per document of scores(doc_id, score, recency) and lists(doc_id, missing, uncited); absent counts are 0.

    plan(doc_id, critical, important, optional, evidence) counts what is pending in the correction plan: risks are raised to it, a
    pending critical item asks for a revision, and pending evidence lowers the two best decisions.
    """
    v, c, n = verification_counts(verification), claim_counts(claims), needed_counts(needed)
    pick = lambda df, prefix: df.select("doc_id", *[F.col(x).alias(f"{prefix}_{x}") for x in df.columns if x != "doc_id"])
    j = scores.join(lists, "doc_id", "left").join(pick(v, "v"), "doc_id", "left").join(pick(c, "c"), "doc_id", "left").join(pick(n, "n"), "doc_id", "left").na.fill(0)
    total = lambda *xs: sum((F.col(x) for x in xs[1:]), F.col(xs[0]))
    j = j.withColumns({
        "critical": total("v_not_found", "v_offline", "v_manual_not_verified", "missing", "c_critical", "n_high"),
        "moderate": total("v_needs_review", "v_not_indexed_but_plausible", "v_keep_needs_review", "c_moderate", "n_medium"),
        "minor": total("v_likely", "uncited", "n_low"),
    })
    if plan is not None:
        j = j.join(pick(plan.select("doc_id", "critical", "important", "optional", "evidence"), "p"), "doc_id", "left").na.fill(0)
    clean: Column = (F.col("uncited") == 0) & (F.col("missing") == 0) & (F.col("v_manual_unresolved") == 0)
    decision = clearance(F.col("score"), F.col("critical"), F.col("moderate"), F.col("recency"), clean)
    if plan is None:
        return j.select("doc_id", "critical", "moderate", "minor", decision.alias("clearance"))
    best = decision.isin("Provisional clearance", "Clearance Recommended")
    decision = F.when(F.col("p_critical") > 0, "Revision Required").when((F.col("p_evidence") > 0) & best, "Conditional Clearance").otherwise(decision)
    raised = [F.greatest(a, f"p_{b}").alias(a) for a, b in (("critical", "critical"), ("moderate", "important"), ("minor", "optional"))]
    return j.select("doc_id", *raised, decision.alias("clearance"))
