"""Streams give what the batch over the same rows gives."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import events as E
from marginalia.streaming import windows as S


def dt(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day - 1)


SF = "/root/testdata/sf0.001/events.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")


@pytest.fixture
def stream(spark, tmp_path):
    batch = spark.read.parquet(SF)
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    return batch.withColumn("ts", batch["ts"].cast("timestamp")), S.read_events(spark, folder, batch.schema)


@pytest.mark.parametrize("f", [S.tumbling_counts, S.sliding_counts, lambda e: S.rate_limit(e, 2)])
def test_windows(spark, tmp_path, stream, f):
    batch, events = stream
    got = S.drain(f(events), "t_" + os.path.basename(tmp_path), str(tmp_path / "c"), "complete")
    assert sorted(map(str, got.collect())) == sorted(map(str, f(batch).collect()))


def test_progress_counts_events_once(spark, tmp_path, stream):
    batch, events = stream
    got = S.drain(S.user_progress(events.union(events), 10, late="90 days", keep="400 days"), "progress", str(tmp_path / "c"), "update")
    last = {r["user_id"]: r["m"] for r in got.groupBy("user_id").agg({"done": "max"}).withColumnRenamed("max(done)", "m").collect()}
    want = {r["user_id"]: r["count"] for r in batch.groupBy("user_id").count().collect()}
    assert last == want


def fed(spark, folder, batches, schema):
    """One file for each batch, read one at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        os.utime(sorted((f for f in os.scandir(f"{folder}/in") if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)[-1].path, (1_000_000 + i * 60, 1_000_000 + i * 60))
    return S.read_events(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)


def test_users_are_forgotten(spark, tmp_path):
    rows = [[(1, 1, dt(1)), (2, 2, dt(1))], [(3, 2, dt(70))], [(4, 2, dt(71))], [(5, 1, dt(80)), (6, 2, dt(81))]]
    events = fed(spark, str(tmp_path), rows, "event_id bigint, user_id bigint, ts timestamp")
    got = S.drain(S.user_progress(events, 10, late="1 day", keep="60 days"), "forgotten", str(tmp_path / "c"), "update")
    last = {}
    for r in got.collect():
        last.setdefault(r["user_id"], []).append(r["done"])
    assert last[2][-1] == 4 and last[1] == [1, 1]  # the first user's count had timed out


def test_expired_content(spark, tmp_path):
    rows = [[(1, dt(1)), (2, dt(1))], [(2, dt(2))], [(3, dt(10))], [(4, dt(10))]]
    events = fed(spark, str(tmp_path), rows, "job_id bigint, ts timestamp")
    got = S.drain(S.expired_content(events, keep="3 days"), "expired", str(tmp_path / "c"))
    assert sorted((r["job_id"], r["deadline"].day) for r in got.collect()) == [(1, 4), (2, 5)]


def test_recent_keys_are_bounded(spark, tmp_path):
    rows = [[("a", "x", dt(1)), ("a", "y", dt(2))], [("a", "z", dt(3)), ("b", "q", dt(3))], [("a", "x", dt(4))]]
    events = fed(spark, str(tmp_path), rows, "scope string, key string, ts timestamp")
    got = [(r["scope"], r["keys"]) for r in S.drain(S.recent_keys(events, 2, keep="10 days"), "recent", str(tmp_path / "c"), "update").collect()]
    assert got[0] == ("a", "y,x") and ("a", "z,y") in got and got[-1] == ("a", "x,z") and ("b", "q") in got


def test_status_stream_matches_the_batch_fold(spark, tmp_path):
    r = random.Random(5)
    kinds = ["retraction", "withdrawal", "reinstatement", "correction", "expression_of_concern", "other_update"]
    rows = [[(f"d{r.randrange(6)}", r.choice(kinds), r.choice(["", f"20{r.randrange(10, 20)}-01-01"]), dt(k + 1)) for _ in range(8)] for k in range(4)]
    schema = "doi string, event_type string, event_date string, ts timestamp"
    events = fed(spark, str(tmp_path), rows, schema)
    out = S.drain(S.status_stream(events, late="900 days"), "statuses", str(tmp_path / "c"), "update").collect()
    got = {x["doi"]: (x["publication_status"], x["events"]) for x in sorted(out, key=lambda x: x["events"])}
    batch = spark.createDataFrame([x for b in rows for x in b], schema).withColumn("event_date", F.coalesce(F.nullif("event_date", F.lit("")), F.lit("9999")))
    folded = batch.select("doi", "event_type", "event_date").distinct().groupBy("doi").agg(F.collect_list(F.struct(F.col("event_type").alias("type"), F.col("event_date").alias("date"))).alias("e"))
    assert got == {x["doi"]: (x["s"], x["n"]) for x in folded.select("doi", E.fold_status(F.col("e"), F.lit(False)).alias("s"), F.size("e").alias("n")).collect()}


def test_chunks_survive_a_kill(spark, tmp_path):
    """The run dies after a chunk is written and before it is committed; the second run goes on from there and counts nothing twice."""
    batch = spark.read.parquet(SF)
    folder, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    batch.repartition(4).write.parquet(folder)
    work = lambda df: df.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    tries = []

    def dying(df):
        tries.append(df.count())
        if len(tries) == 3:  # the second chunk is written, the third one dies while it is worked on
            raise RuntimeError("killed")
        return work(df)

    total = batch.count()
    with pytest.raises(Exception, match="killed"):
        S.run_chunks(S.read_events(spark, folder, batch.schema), dying, out, marks)
    half = S.chunk_progress(S.chunk_results(spark, out, "user_id bigint, rows bigint"), "rows", total).first()
    assert half["chunks"] == 2 and half["state"] == "running" and half["done"] == sum(tries[:2]) and half["percentage"] == half["done"] * 100 // total
    # the last commit is lost too, as if the run had died between the writing of a chunk and its commit
    for name in ("1", ".1.crc"):
        os.remove(f"{marks}/commits/{name}")
    S.run_chunks(S.read_events(spark, folder, batch.schema), work, out, marks)
    results = S.chunk_results(spark, out, "user_id bigint, rows bigint")
    end = S.chunk_progress(results, "rows", total).first()
    assert (end["chunks"], end["done"], end["percentage"], end["state"]) == (4, total, 100, "completed")
    assert sorted(map(tuple, results.groupBy("user_id").agg(F.sum("rows")).collect())) == sorted(map(tuple, work(batch).collect()))
