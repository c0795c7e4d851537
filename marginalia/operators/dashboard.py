"""Dashboard projections over jobs with JSON results, rollups and exports."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_at(v: Column, *paths: str) -> Column:
    """First number that is not zero among JSON paths, else 0: zero falls through to the next alias."""
    return F.coalesce(*[F.nullif(F.try_variant_get(v, p, "bigint"), F.lit(0).cast("bigint")) for p in paths], F.lit(0).cast("bigint"))


def list_length(v: Column, path: str) -> Column:
    return F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")).cast("bigint"), F.lit(0).cast("bigint"))


def whole_number(v: Column, *paths: str) -> Column:
    """Of the first JSON path that is there, the number if it is made of digits only, else null."""
    text = F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def array_size(v: Column, path: str) -> Column:
    """Length of a JSON list, null where there is none."""
    return F.size(F.try_variant_get(v, path, "array<variant>")).cast("bigint")


def is_object(v: Column, path: str) -> Column:
    return F.coalesce(F.startswith(F.to_json(F.try_variant_get(v, path, "variant")), F.lit("{")), F.lit(False))


#: Track operations of an accepted decision that counts as approved.
TRACKED = ("replace", "delete", "insert_after", "append_reference", "insert_after_and_append_reference")


def verification_metrics(jobs: DataFrame) -> DataFrame:
    """Verification rows and the five states of each job's summary: a number at either place, else the length of the rows, else 0."""
    v, zero = F.try_parse_json("result"), F.lit(0).cast("bigint")
    rows = F.coalesce(whole_number(v, "$.online_verification.summary.total"), whole_number(v, "$.verification.total"), array_size(v, "$.online_verification.rows"), zero)
    states = [F.coalesce(whole_number(v, f"$.online_verification.summary.{k}"), zero).alias(k) for k in ("verified", "likely", "needs_review", "not_found", "offline")]
    return jobs.select("job_id", rows.alias("verification_rows"), *states)


def work_metrics(jobs: DataFrame) -> DataFrame:
    """Claims, recovery rows (both lists) and suggestions of each job."""
    v, zero = F.try_parse_json("result"), F.lit(0).cast("bigint")
    n = lambda p: F.coalesce(array_size(v, p), zero)
    return jobs.select(
        "job_id", n("$.claim_support").alias("claims"), (n("$.recovery.missing_recovery") + n("$.recovery.verification_recovery")).alias("recovery"),
        F.coalesce(array_size(v, "$.suggestions"), array_size(v, "$.suggestions.citations"), zero).alias("suggestions"),
    )


def evidence_metrics(jobs: DataFrame) -> DataFrame:
    """Totals of the evidence workspace of each job, from the first of three places, and whether there is one."""
    v, zero = F.try_parse_json("result"), F.lit(0).cast("bigint")
    at = lambda k, usage: F.coalesce(whole_number(v, f"$.evidence_resolution_workspace.counts.{k}", f"$.correction_plan.evidence_resolution_workspace.counts.{k}", f"$.feature_usage.{usage}"), zero)
    there = is_object(v, "$.evidence_resolution_workspace") | is_object(v, "$.correction_plan.evidence_resolution_workspace")
    analyses = F.when(there, F.lit(1).cast("bigint")).otherwise(F.coalesce(whole_number(v, "$.feature_usage.evidence_workspace_analyses"), zero))
    return jobs.select("job_id", at("total", "evidence_issues_generated").alias("total"), at("pending", "evidence_issues_pending").alias("pending"), at("resolved", "evidence_issues_resolved").alias("resolved"), analyses.alias("analyses"))


def tracked_approvals(jobs: DataFrame) -> DataFrame:
    """Accepted decisions of each job whose operation is a tracked change, else the recorded number."""
    v = F.try_parse_json("result")
    entries = F.map_values(F.from_json(F.to_json(F.try_variant_get(v, "$.correction_decisions", "variant")), "map<string,struct<decision:string,track_operation:string>>"))
    good = F.filter(entries, lambda e: (F.lower(F.coalesce(e["decision"], F.lit(""))) == "accepted") & F.lower(F.coalesce(e["track_operation"], F.lit(""))).isin(*TRACKED))
    recorded = F.coalesce(whole_number(v, "$.feature_usage.tracked_approvals_current"), F.lit(0).cast("bigint"))
    return jobs.select("job_id", F.when(is_object(v, "$.correction_decisions"), F.size(good).cast("bigint")).otherwise(recorded).alias("approvals"))


def voice_flags(jobs: DataFrame) -> DataFrame:
    """Writing review of each job: enabled, completed, signals and revisions, from the result or the recorded usage."""
    v, zero, one = F.try_parse_json("result"), F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    usage = lambda k: F.coalesce(whole_number(v, f"$.feature_usage.{k}"), zero)
    on = F.lower(F.coalesce(F.try_variant_get(v, "$.academic_voice_settings.enabled", "string"), F.lit("")))
    keys = F.size(F.map_keys(F.from_json(F.to_json(F.try_variant_get(v, "$.academic_voice_revisions", "variant")), "map<string,string>"))).cast("bigint")
    return jobs.select(
        "job_id", F.when(on == "true", one).when(on == "false", zero).otherwise(usage("academic_voice_enabled_analyses")).alias("enabled"),
        F.when(is_object(v, "$.academic_voice_review"), one).otherwise(usage("academic_voice_completed_analyses")).alias("completed"),
        F.coalesce(array_size(v, "$.academic_voice_review.signals"), usage("academic_voice_signals")).alias("signals"),
        F.when(is_object(v, "$.academic_voice_revisions"), keys).otherwise(usage("academic_voice_approved_revisions")).alias("revisions"),
    )


def job_metrics(jobs: DataFrame) -> DataFrame:
    """words, references (summary, else length of the raw list), index score and paid flag of each job."""
    v = F.try_parse_json("result")
    listed = number_at(v, "$.summary.reference_entries_found")
    return jobs.select(
        "job_id", "status", number_at(v, "$.summary.word_count").alias("words"), F.when(listed > 0, listed).otherwise(list_length(v, "$.raw_references")).alias("references"),
        F.coalesce(F.try_variant_get(v, "$.acii.score", "double"), F.try_variant_get(v, "$.score", "double")).alias("score"), F.coalesce(F.try_variant_get(v, "$.paid", "boolean"), F.lit(False)).alias("paid"),
    )


def status_rollup(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.agg(
        F.count(F.lit(1)).alias("jobs"), *[F.count_if(s == k).alias(k) for k in ("completed", "queued", "failed")], F.min("created_at").cast("date").alias("first_day"), F.max("created_at").cast("date").alias("last_day"),
        F.round(F.avg(F.when(s == "completed", F.nullif("processing_time", F.lit(0.0)))), 4).alias("avg_seconds"),
        F.round(F.count_if(s == "completed") / F.nullif(F.count_if(s.isin("completed", "failed")), F.lit(0)), 6).alias("success_rate"),
    )


def daily_rollup(jobs: DataFrame) -> DataFrame:
    s = F.col("status")
    return jobs.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.round(F.avg(F.nullif("processing_time", F.lit(0.0))) + 1e-7, 4).alias("avg_seconds"))


def overlay_daily(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two daily counts merged, the greater one of each day."""
    return a.select("day", F.col("n").alias("n_a")).join(b.select("day", F.col("n").alias("n_b")), "day", "full").select("day", F.greatest(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))).alias("n"))


def decisions(jobs: DataFrame) -> DataFrame:
    """job_id, item, decision of the decisions object of every result."""
    v = F.try_parse_json("result")
    d = jobs.select("job_id", F.from_json(F.to_json(F.try_variant_get(v, "$.decisions", "variant")), "map<string,struct<decision:string>>").alias("d"))
    return d.select("job_id", F.explode("d").alias("item", "v")).select("job_id", "item", F.col("v.decision").alias("decision"))


#: Keys whose values are decisions, wherever they stand.
DECISION_KEYS = ("manual_decision", "manual_decision_label", "display_status", "decision")


def decision_values(text: str | None) -> list[str]:
    """Lower-cased values of the decision keys at any depth of a JSON text, in document order; what such a key holds is not searched further."""
    try:
        stack = [json.loads(text or "null")]
    except (ValueError, RecursionError):
        return []
    out = []
    while stack:
        at = stack.pop()
        if isinstance(at, tuple):
            out.append(str(at[0]).strip().lower())
        elif isinstance(at, dict):
            found = [(v,) if k in DECISION_KEYS else v for k, v in at.items() if v or k not in DECISION_KEYS]
            stack += reversed(found)
        elif isinstance(at, list):
            stack += reversed(at)
    return out


def all_decisions(jobs: DataFrame) -> DataFrame:
    """job_id, value, n of the decisions at any depth of every result; a result that is no JSON has none."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([decision_values(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    values = jobs.select("job_id", F.explode(found(F.col("result").cast("string"))).alias("value"))
    return values.groupBy("job_id", "value").agg(F.count(F.lit(1)).alias("n"))


def window_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.sum("words").alias("words"), F.sum("references").alias("references"), F.round(F.avg("score"), 4).alias("avg_score"), F.count_if("paid").alias("paid"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with a text in one of several columns, in any case."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).ilike(f"%{text}%")
    return rows.filter(cond)


def recent(rows: DataFrame, by: list[Column], n: int) -> DataFrame:
    """The first n rows of an order; kept as a top-k, never a full sort."""
    return rows.orderBy(*by).limit(n)


def export_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """Fixed columns as CSV with a header, null as empty."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)
