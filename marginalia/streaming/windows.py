"""Streams over events: tumbling, sliding and session counts, daily counters, and state that times out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marginalia.operators.events import TYPE_ORDER

#: State that an event of a type sets whatever stood before.
ENDS = {"retraction": "retracted", "withdrawal": "withdrawn", "reinstatement": "reinstated"}


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; times without a zone become timestamps, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    w = F.window("ts", width)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "2 days") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def rate_limit(events: DataFrame, limit: int, width: str = "1 minute", late: str = "2 days") -> DataFrame:
    """Requests of each user by fixed minutes, and whether the limit is passed."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "user_id", "n", (F.col("n") > limit).alias("limited"))


def _ms(text: str) -> int:
    """A span such as ``2 days`` in milliseconds."""
    return int(pd.Timedelta(text).total_seconds() * 1000)


def user_progress(events: DataFrame, total: int, late: str = "2 days", keep: str = "30 days") -> DataFrame:
    """Progress of each user towards total events; a late or repeated event id is not counted twice.

    State holds a count only; ids are made unique by a watermarked distinct before it. A user without an event for keep of
    event time is forgotten.
    """
    span = _ms(keep)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, newest = (state.get[0] if state.exists else 0), 0
        for b in batches:
            n += len(b)
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
        state.update((n,))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + span)
        yield pd.DataFrame({"user_id": [key[0]], "done": [n], "percentage": [min(100, 100 * n // total)]})

    unique = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return unique.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, done bigint, percentage bigint", "done bigint", "update", GroupStateTimeout.EventTimeTimeout)


def expired_content(rows: DataFrame, keep: str = "1 day", late: str = "1 hour") -> DataFrame:
    """job_id, deadline of rows(job_id, ts) once the stream's time has passed the deadline: the last ts of the job and keep."""
    span = _ms(keep)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            due = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "deadline": [pd.Timestamp(due, unit="ms")]})
            return
        due = max([state.get[0] if state.exists else 0, *[int(b["ts"].max().timestamp() * 1000) + span for b in batches]])
        state.update((due,))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return rows.withWatermark("ts", late).groupBy("job_id").applyInPandasWithState(step, "job_id bigint, deadline timestamp", "due bigint", "append", GroupStateTimeout.EventTimeTimeout)


def recent_keys(events: DataFrame, most: int, keep: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Per scope of events(scope, key, ts) the most recently used keys, newest first: at most most, none older than keep.

    State is bounded by most; a scope that has not been used for keep is forgotten.
    """
    span = _ms(keep)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = dict(zip(*state.get, strict=True)) if state.exists else {}
        for b in batches:
            for k, t in zip(b["key"], b["ts"], strict=True):
                used[k] = max(used.get(k, 0), int(t.timestamp() * 1000))
        newest = max(used.values())
        kept = sorted((k for k, t in used.items() if t > newest - span), key=lambda k: (-used[k], k))[:most]
        state.update((kept, [used[k] for k in kept]))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + span)
        yield pd.DataFrame({"scope": [key[0]], "keys": [",".join(kept)]})

    return events.withWatermark("ts", late).groupBy("scope").applyInPandasWithState(step, "scope string, keys string", "keys array<string>, times array<bigint>", "update", GroupStateTimeout.EventTimeTimeout)


def status_stream(events: DataFrame, late: str = "2 days", keep: str = "3650 days") -> DataFrame:
    """doi, publication_status, events: the fold of all events(doi, event_type, event_date, ts) of a DOI so far, in whatever order they come.

    State holds the distinct (date, type) of a DOI; it goes when the DOI has had no event for keep.
    """
    span = _ms(keep)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known, newest = set(zip(*state.get, strict=True)) if state.exists else set(), 0
        for b in batches:
            known |= {(d or "9999", t) for d, t in zip(b["event_date"], b["event_type"], strict=True)}
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
        ordered = sorted(known, key=lambda e: (e[0], TYPE_ORDER.get(e[1], 5), e[1]))
        state.update(([d for d, _ in ordered], [t for _, t in ordered]))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1) + span)
        status = "clear"
        for _, t in ordered:
            if t in ENDS:
                status = ENDS[t]
            elif t == "expression_of_concern" and status not in ("retracted", "withdrawn"):
                status = t
            elif t == "correction" and status == "clear":
                status = "corrected"
        yield pd.DataFrame({"doi": [key[0]], "publication_status": [status], "events": [len(ordered)]})

    return events.withWatermark("ts", late).groupBy("doi").applyInPandasWithState(step, "doi string, publication_status string, events bigint", "dates array<string>, types array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def run_chunks(stream: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> None:
    """Work through what a stream has, a chunk at a time, so that it can be killed and started again.

    A chunk's results replace the folder of its number, so a chunk that was written but not committed when the run died
    is written again, with the same rows (the checkpoint has its files), and counts once.
    """

    def keep(chunk: DataFrame, number: int) -> None:
        work(chunk).write.mode("overwrite").parquet(f"{folder}/chunk={number}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def chunk_results(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Rows of all chunks so far, each with the number of its chunk; the schema is that of the work."""
    return spark.read.schema(schema).option("basePath", folder).parquet(f"{folder}/chunk=*").withColumn("chunk", F.regexp_extract(F.input_file_name(), r"chunk=([0-9]+)", 1).cast("bigint"))


def chunk_progress(results: DataFrame, done: str, total: int) -> DataFrame:
    """chunks, done (the sum of a column), percentage (whole, 100 only when all is done) and state of a run of so many rows."""
    sums = results.agg(F.countDistinct("chunk").alias("chunks"), F.coalesce(F.sum(done), F.lit(0)).cast("bigint").alias("done"))
    share = F.floor(F.least(F.col("done"), F.lit(total)) * 100 / F.greatest(F.lit(total), F.lit(1)))
    return sums.select("chunks", "done", share.cast("bigint").alias("percentage"), F.when(F.col("done") >= total, "completed").otherwise("running").alias("state"))


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there into a memory table and return it; for tests and backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
