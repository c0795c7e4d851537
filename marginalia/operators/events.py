"""Publication events: normal forms, index, ordered fold into a current status, summaries and risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.functions.text import normal_doi

#: Order of types on one day.
TYPE_ORDER = {"expression_of_concern": 1, "correction": 2, "retraction": 3, "withdrawal": 3, "reinstatement": 4}


def event_type(label: Column) -> Column:
    raw = F.translate(F.lower(label), "_-", "  ")
    has = lambda w: raw.contains(w)
    return (
        F.when(has("reinstate"), "reinstatement").when(has("expression") & has("concern"), "expression_of_concern").when(has("retract"), "retraction").when(has("withdraw"), "withdrawal")
        .when(has("correction") | has("corrigendum") | has("erratum"), "correction").otherwise("other_update")
    )


def event_date(value: Column) -> Column:
    """ISO date of the three input forms, else the text itself."""
    iso = [F.to_date(F.try_to_timestamp(value, F.lit(f))).cast("string") for f in ("yyyy-MM-dd", "M/d/yyyy H:mm", "M/d/yyyy")]
    return F.coalesce(*iso, value)


def event_index(raw: DataFrame) -> DataFrame:
    """doi, event_type, event_date, record_id of raw(link, label, event_date, record_id), repeats dropped by both keys in turn."""
    e = raw.select(normal_doi(F.col("link")).alias("doi"), event_type(F.col("label")).alias("event_type"), "event_date", "record_id")
    first = W.partitionBy("event_type", "doi", "event_date").orderBy("record_id")
    e = e.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    return e.dropDuplicates(["record_id", "event_type", "doi", "event_date"])


def type_rank(kind: Column) -> Column:
    rank = F.lit(5)
    for name, r in TYPE_ORDER.items():
        rank = F.when(kind == name, r).otherwise(rank)
    return rank


def fold_status(events: Column, is_notice: Column) -> Column:
    """Current status of an array of structs (type, date): sorted by (date or 9999, rank), then folded.

    A retraction sets retracted, a withdrawal withdrawn; a reinstatement ends any state; concern does not replace either of
    the two; a correction counts only when nothing else stands.
    """
    ordered = F.array_sort(F.transform(events, lambda e: F.struct(F.coalesce(F.nullif(e["date"], F.lit("")), F.lit("9999")).alias("d"), type_rank(e["type"]).alias("r"), e["type"].alias("t"))))

    def step(state: Column, e: Column) -> Column:
        t = e["t"]
        return (
            F.when(t == "retraction", "retracted")
            .when(t == "withdrawal", "withdrawn")
            .when(t == "reinstatement", "reinstated")
            .when((t == "expression_of_concern") & ~state.isin("retracted", "withdrawn"), "expression_of_concern")
            .when((t == "correction") & (state == "clear"), "corrected")
            .otherwise(state)
        )

    return F.when(is_notice, F.lit("publication_notice")).otherwise(F.aggregate(ordered, F.lit("clear"), step))


def publication_status(fields: DataFrame, index: DataFrame, notices: DataFrame) -> DataFrame:
    """ref status from the index: publication_status and event count for every reference; events are gathered per DOI once."""
    per_doi = index.groupBy("doi").agg(F.collect_list(F.struct(F.col("event_type").alias("type"), F.col("event_date").alias("date"))).alias("events"))
    status = per_doi.join(notices.select("doi").distinct().withColumn("notice", F.lit(True)), "doi", "left").select(
        "doi", fold_status(F.col("events"), F.coalesce("notice", F.lit(False))).alias("s"), F.size("events").cast("bigint").alias("k")
    )
    return fields.join(status, "doi", "left").select("doc_id", "ref_idx", F.coalesce("s", F.lit("clear")).alias("publication_status"), F.coalesce("k", F.lit(0)).alias("event_count"))


def publication_summary(rows: DataFrame) -> DataFrame:
    """Current status per reference, counted by document: seven buckets, checked and unchecked rows, and whether all are checked."""
    s = F.col("publication_status")
    kinds = ("expression_of_concern", "corrected", "reinstated", "publication_notice")
    other = (s == "clear") & (F.col("event_count") > 0)
    known = s.isin("retracted", "withdrawn", "clear", *kinds)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s.isin("retracted", "withdrawn")).alias("retracted_or_withdrawn"), *[F.count_if(s == k).alias(k) for k in kinds],
        F.count_if(other).alias("other_update"), F.count_if((s == "clear") & ~other).alias("no_recorded_event"), F.count_if(known).alias("checked"), F.count_if(~known).alias("unchecked"), F.every(known).alias("complete"),
    )


#: Names of a risk and its priority by publication status; the first that fits counts.
STATUS_RISKS = (
    (("retracted", "withdrawn"), "retracted_or_withdrawn", "critical"),
    (("expression_of_concern",), "expression_of_concern", "critical"),
    (("publication_notice",), "publication_notice", "optional"),
    (("corrected",), "corrected_publication", "important"),
    (("reinstated",), "reinstated_publication", "optional"),
    (("unchecked",), "publication_status_unchecked", "important"),
)
#: Update types of a superseded record, types of sources that are not scholarly, link states that are fine.
SUPERSEDED = ("correction", "corrigendum", "erratum", "update", "is-corrected-by", "is-superseded-by")
NOT_SCHOLARLY = ("web", "webpage", "blog", "news", "social-media")
LINK_FINE = ("200", "201", "202", "204")


def source_risks(rows: DataFrame, current_year: int, review_list: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, risk, priority, n: the risks of verification rows, counted."""
    return risk_rows(rows, current_year, review_list).groupBy("doc_id", "risk", "priority").agg(F.count(F.lit(1)).alias("n"))


def risk_rows(rows: DataFrame, current_year: int, review_list: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ref_idx, risk, priority: every rule over verification rows, exploded.

    review_list: journal names (lower case) that the institution wants looked at. A row gets one risk of its publication
    status at most; all other rules stand by themselves. A DOI counts as repeated from its second reference on.
    """
    text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("")))
    doi = lambda c: F.replace(text(c), F.lit("https://doi.org/"), F.lit(""))
    rule = lambda cond, name, priority: F.when(cond, F.struct(F.lit(name).alias("risk"), F.lit(priority).alias("priority")))
    status, s = text("status"), text("publication_status")
    by_status = F.lit(None)
    for states, name, priority in reversed(STATUS_RISKS):
        by_status = F.when(s.isin(*states), F.struct(F.lit(name).alias("risk"), F.lit(priority).alias("priority"))).otherwise(by_status)
    by_status = F.coalesce(by_status, rule(F.col("event_count") > 0, "other_publication_update", "optional"))
    found, own = doi("doi"), doi("ref_doi")
    rows = rows.withColumn("__doi", F.coalesce(F.nullif(found, F.lit("")), F.nullif(own, F.lit(""))))
    repeated = F.col("__doi").isNotNull() & (F.col("ref_idx") > F.min("ref_idx").over(W.partitionBy("doc_id", "__doi")))
    rules = F.array_compact(
        F.array(
            rule(status.isin("not_found", "unverified", "failed"), "metadata_not_found", "important"),
            by_status,
            rule(~s.isin("corrected", "reinstated", "publication_notice") & text("update_type").isin(*SUPERSEDED), "corrected_or_superseded", "important"),
            rule(F.lit(current_year) - F.col("year") > 10, "older_source", "optional"),
            rule(text("source_type").isin(*NOT_SCHOLARLY), "non_scholarly_source", "important"),
            rule((own != "") & (found != "") & (own != found), "doi_mismatch", "critical"),
            rule(repeated, "duplicate_publication_entry", "important"),
            rule(F.trim(text("journal")).isin(*review_list) if review_list else F.lit(False), "journal_on_configured_review_list", "critical"),
            rule((text("link_status") != "") & ~text("link_status").isin(*LINK_FINE), "reference_link_unavailable", "optional"),
        )
    )
    return rows.withColumn("__rules", rules).select("doc_id", "ref_idx", F.inline("__rules"))
