"""Credit ledger over append-only facts: balances, first-in-first-out spending, schedules, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def usable(as_of: Column) -> Column:
    """Lots available and not expired at a date."""
    return (F.col("available_at") <= as_of) & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def balances(lots: DataFrame, as_of: Column) -> DataFrame:
    return lots.filter(usable(as_of)).groupBy("account_id").agg(F.sum("remaining").alias("balance"), F.count(F.lit(1)).alias("lots"))


def fifo_spend(lots: DataFrame, cost: int, as_of: Column) -> DataFrame:
    """What a cost takes from each usable lot, soonest expiry first (none last), for accounts that can pay it."""
    order = W.partitionBy("account_id").orderBy(F.col("expires_at").asc_nulls_last(), "available_at", "lot_id")
    before = F.coalesce(F.sum("remaining").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("remaining").over(W.partitionBy("account_id"))
    take = F.greatest(F.lit(0), F.least(F.col("remaining"), F.lit(cost) - before))
    return lots.filter(usable(as_of)).withColumn("units", take).withColumn("whole", whole).filter((F.col("whole") >= cost) & (F.col("units") > 0)).select("account_id", "lot_id", F.col("units").cast("bigint").alias("units"))


def rollover_surplus(lots: DataFrame, most: int, as_of: Column) -> DataFrame:
    """Units to take from the oldest lots so that an account keeps at most most."""
    newest = W.partitionBy("account_id").orderBy(F.col("available_at").desc(), F.col("lot_id").desc())
    kept_before = F.coalesce(F.sum("remaining").over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    keep = F.greatest(F.lit(0), F.least(F.col("remaining"), F.lit(most) - kept_before))
    return lots.filter(usable(as_of)).withColumn("surplus", (F.col("remaining") - keep).cast("bigint")).filter("surplus > 0").select("account_id", "lot_id", "surplus")


def release_schedule(plans: DataFrame, as_of: Column) -> DataFrame:
    """Monthly lots of paid plans that are due: month k starts k months after the anchor itself, clipped to the month's end."""
    months = plans.filter("status = 'paid'").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("months") - 1)))
    due = F.add_months("starts_at", F.col("k"))
    return months.select("order_id", "account_id", F.col("k").cast("bigint").alias("month_no"), due.alias("due_at"), F.add_months("starts_at", F.col("k") + 1).alias("ends_at"), "credits").filter(F.col("due_at") <= as_of)


def active_plan(plans: DataFrame, as_of: Column) -> DataFrame:
    """The paid plan of each account whose term holds a date; the latest end wins, then the largest order."""
    ends = F.add_months("starts_at", F.col("months"))
    live = plans.filter("status = 'paid'").withColumn("ends_at", ends).filter((F.col("starts_at") <= as_of) & (F.col("ends_at") > as_of))
    best = live.groupBy("account_id").agg(F.max(F.struct("ends_at", "order_id")).alias("b"))
    return best.select("account_id", F.col("b.order_id").alias("order_id"), F.col("b.ends_at").alias("ends_at"))


def insert_once(ledger: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys the ledger does not have, each key once."""
    return new.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert read as the latest row of each key."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def refunds(spends: DataFrame, lots: DataFrame, as_of: Column) -> DataFrame:
    """Where refunded units go: back to a lot that still holds, else into a new lot of one month."""
    joined = spends.join(lots.select("lot_id", "expires_at"), "lot_id")
    gone = F.col("expires_at").isNotNull() & (F.col("expires_at") <= as_of)
    return joined.select("lot_id", "account_id", "units", F.when(gone, "reissued").otherwise("returned").alias("how"), F.when(gone, F.add_months(as_of, 1)).otherwise(F.col("expires_at")).alias("new_expiry"))


def rate_buckets(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """Requests of each user in fixed buckets of seconds, and whether the limit is passed."""
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    out = events.groupBy("user_id", (F.floor(epoch / seconds) * seconds).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("limited", F.col("n") > limit)
