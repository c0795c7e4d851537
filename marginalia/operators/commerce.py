"""Orders, grants, reports and payments: the small joins around accounts, quotes and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.operators.access import kept_content

#: States of a job that has failed for good.
FATAL = ("failed", "error")


def with_account(orders: DataFrame, accounts: DataFrame) -> DataFrame:
    """Orders with the address of their account; an order without an account is left out."""
    return orders.join(accounts.select("account_id", "email"), "account_id")


def report_links(reports: DataFrame, grants: DataFrame, most: int = 100) -> DataFrame:
    """The newest reports of each account, with the grant that unlocked them if there is one."""
    order = W.partitionBy("account_id").orderBy(F.col("created_at").desc(), F.col("job_id").desc())
    newest = reports.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= most).drop("__k")
    return newest.join(grants.select("job_id", "credits", "refunded_at"), "job_id", "left")


def failed_grants(grants: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs of grants to refund: failed ones whose grant is not refunded yet."""
    return grants.filter("refunded_at is null").select("job_id").join(jobs.filter(F.col("status").isin(*FATAL)).select("job_id"), "job_id")


def due_confirmations(purchases: DataFrame, jobs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Paid purchases of the card provider, unexpired, whose preview is complete and kept, not confirmed, and not tried within minutes."""
    tried = F.col("attempted_at").isNull() | (F.col("attempted_at") < now - F.expr(f"INTERVAL '{minutes}' MINUTES"))
    open_ = F.col("status").isin("paid", "active") & F.col("confirmed_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now)) & (F.col("provider") == "stripe") & tried
    done = jobs.filter((F.col("status") == "completed") & kept_content()).select(F.col("job_id").alias("preview_job_id"))
    return purchases.filter(open_).join(done, "preview_job_id").select("purchase_id", "preview_job_id", "created_at")


def linked_status(runs: DataFrame, purchases: DataFrame) -> DataFrame:
    """Every run with the status of its purchase, null where the purchase is gone."""
    return runs.join(purchases.select("purchase_id", F.col("status").alias("linked_status")), "purchase_id", "left")


def among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is one of a list: a semi join, however long the list."""
    return rows.join(ids.select(key), key, "left_semi")


def commercial_totals(records: DataFrame) -> DataFrame:
    """One row: jobs, paid jobs, revenue of paid ones and sums of the counts; zeros when there are no records."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return records.agg(
        F.count(F.lit(1)).alias("total_jobs"), zero(F.sum(F.col("paid").cast("bigint"))).alias("paid_jobs"), F.round(F.coalesce(F.sum(F.when(F.col("paid"), F.col("amount"))), F.lit(0.0)), 2).alias("revenue"),
        *[zero(F.sum(c)).alias(f"total_{c}") for c in ("references", "citations", "verified", "not_found")],
    )


def upload_counters(uploads: DataFrame, cutoff: Column) -> DataFrame:
    """Counters recomputed after uploads before a day are gone: uploads, processed, failed, references checked."""
    kept = uploads.filter(F.to_date("ts") >= cutoff)
    return kept.agg(F.count(F.lit(1)).alias("total_uploads"), F.count_if("success").alias("total_processed"), F.count_if(~F.col("success")).alias("total_failed"), F.coalesce(F.sum("references"), F.lit(0)).alias("total_references"))


def first_status(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Counts by the first of several fields that is filled, trimmed and lower-cased; rows without any do not count."""
    status = F.lower(F.trim(F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in fields])))
    return rows.withColumn("status", status).filter("status <> ''").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def quotes(requests: DataFrame, grants: DataFrame, balances: DataFrame, now: Column) -> DataFrame:
    """What unlocking each request(account_id, job_id, fingerprint, cost, recheck_of) costs.

    Nothing for a job that the account has unlocked, or for a text like one whose recheck is still open (the oldest such);
    nothing for the one included recheck of an open grant that is no recheck itself; else the cost. refused: another
    account's job, or a recheck that is not open.
    """
    live = grants.filter("refunded_at is null")
    own = live.select("job_id", F.col("account_id").alias("owner"))
    twins = live.filter((F.col("recheck_until") > now) & (F.coalesce("fingerprint", F.lit("")) != ""))
    twins = twins.groupBy("account_id", "fingerprint").agg(F.min(F.struct("created_at", "job_id")).alias("t")).select("account_id", "fingerprint", F.col("t.job_id").alias("duplicate_of"))
    first = live.filter(F.col("recheck_of").isNull() & (F.col("recheck_until") > now)).select(F.col("job_id").alias("recheck_of"), "account_id", F.col("cost").alias("first_cost"))
    used = live.filter("recheck_of is not null").select("recheck_of").distinct().withColumn("used", F.lit(True))
    j = requests.join(own, "job_id", "left").join(twins, ["account_id", "fingerprint"], "left").join(first, ["recheck_of", "account_id"], "left").join(used, "recheck_of", "left").join(balances.select("account_id", "balance"), "account_id", "left")
    unlocked = F.col("owner") == F.col("account_id")
    again = F.col("recheck_of").isNotNull()
    open_ = F.col("first_cost").isNotNull() & F.col("used").isNull() & (F.col("cost") <= F.col("first_cost"))
    kind = (
        F.when(F.col("owner").isNotNull() & ~unlocked, "refused_other_account").when(unlocked, "already_unlocked").when(F.col("duplicate_of").isNotNull(), "duplicate")
        .when(again & ~F.coalesce(open_, F.lit(False)), "refused_recheck").when(again, "recheck").otherwise("credits")
    )
    balance = F.coalesce("balance", F.lit(0))
    price = F.when(F.col("kind") == "credits", F.col("cost")).otherwise(0)
    can = ~F.startswith(F.col("kind"), F.lit("refused")) & ((F.col("kind") != "credits") | (balance >= F.col("cost")))
    return j.withColumn("kind", kind).select("account_id", "job_id", "kind", price.cast("bigint").alias("price"), balance.cast("bigint").alias("balance"), can.alias("can_unlock"))
