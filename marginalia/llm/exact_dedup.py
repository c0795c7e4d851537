"""Exact deduplication against immutable snapshots, screened by static binary-fuse filters.

A snapshot is a Parquet table of distinct digests with their group facts, in a folder for each bucket of digests, and for
each bucket a static 3-wise binary-fuse filter of 8-bit fingerprints (about 9 bits a digest, false positives 1/256,
no false negatives). A new batch is grouped by digest on its own; its distinct digests meet only the filters of
their bucket; negatives are new and become the batch's own snapshot, positives join the exact digests of their
buckets and are kept beside them as increments. No snapshot is written twice; facts and increments meet once, at the
end. Then the texts of every group of several are compared byte by byte.

Defined results: null text counts as empty, and empty texts are equal. Texts are equal when identical after deleting
all characters of ``[\\x20\\x09-\\x0D]``. Of equal texts the one with the most code points stays, then the smallest id,
null ids last; repeated rows give a row each, and exactly one row of a group is kept. Ids are integers (an id of another
type is an error). Columns beside id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ASCII_SPACE, discard, materialise, materialise_by, split_join

#: Digests of a bucket, about; and the least number of buckets.
BUCKET_DIGESTS, LEAST_BUCKETS = 250_000, 16
#: Ids up to this many (under 10 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 100_000


# --- the filter
def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in consecutive segments for each key, and its fingerprint."""
    with np.errstate(over="ignore"):
        h = keys ^ np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    first = (h >> np.uint64(40)).astype(np.int64) % segments
    low = np.int64(segment - 1)
    at = [(first + i) * segment + ((h >> np.uint64(13 * i)).astype(np.int64) & low) for i in range(3)]
    with np.errstate(over="ignore"):
        print_ = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
    return np.stack(at), print_


def build_filter(keys: np.ndarray, seed: int = 1) -> tuple[int, int, int, bytes]:
    """(seed, segment, segments, table) of a static filter of distinct uint64 keys; peeled in whole rounds."""
    n = len(keys)
    segment = 1 << int(np.clip(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25), 2, 13))
    slots = int(max(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))), 1)) + 1
    segments = max(1, -(-slots // segment) - 2)
    while True:
        at, print_ = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # exclusive or of the numbers of the keys in a slot
        for i in range(3):
            np.bitwise_xor.at(held, at[i], np.arange(n))
        rounds, left = [], n
        lone = np.flatnonzero(count == 1)
        while len(lone):
            key, first = np.unique(held[lone], return_index=True)
            slot = lone[first]
            rounds.append((key, slot))
            left -= len(key)
            for i in range(3):
                np.subtract.at(count, at[i, key], 1)
                np.bitwise_xor.at(held, at[i, key], key)
            touched = np.unique(at[:, key].ravel())
            lone = touched[count[touched] == 1]
        if not left:
            break
        seed = seed * 2862933555777941757 + 3037000493 & (1 << 62) - 1
        segments += 1 + segments // 64
    table = np.zeros(size, np.uint8)
    for key, slot in reversed(rounds):
        table[slot] = 0
        table[slot] = print_[key] ^ table[at[0, key]] ^ table[at[1, key]] ^ table[at[2, key]]
    return seed, segment, segments, table.tobytes()


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    at, print_ = _slots(keys, seed, segment, segments)
    t = np.frombuffer(table, np.uint8)
    return (t[at[0]] ^ t[at[1]] ^ t[at[2]]) == print_


# --- snapshots and batches
@dataclass
class Snapshot:
    """groups(__digest, __size, __best, __key, __bucket) in a folder for each bucket, and filters(__bucket, ...); never changed."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def normal(text):
    return F.translate(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __row, __n (code points of the text), __digest (32 bytes), one row per document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("__id"), F.monotonically_increasing_id().alias("__row"), F.length(text).alias("__n"), F.unhex(F.sha2(normal(F.col(text_col)), 256)).alias("__digest")
    )


def _best():
    # the least: most code points, then the smallest id (null last), then the first row
    return F.min(F.named_struct(F.lit("fewer"), -F.col("__n"), F.lit("none"), F.col("__id").isNull(), F.lit("id"), F.col("__id"), F.lit("row"), F.col("__row")))


def grouped(rows: DataFrame) -> DataFrame:
    """A batch's own duplicates: one row for each digest with its size and best document."""
    return rows.groupBy("__digest").agg(F.count(F.lit(1)).alias("__size"), _best().alias("__best"))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.conv(F.hex(F.substring("__digest", 1, 7)), 16, 10).cast("bigint")
    return groups.withColumn("__key", key).withColumn("__bucket", F.pmod(F.xxhash64("__digest"), F.lit(buckets)).cast("int"))


def snapshot(groups: DataFrame) -> Snapshot:
    """An immutable snapshot of distinct digests: the exact table and a filter for each bucket. groups: materialised."""
    buckets = max(LEAST_BUCKETS, groups.count() // BUCKET_DIGESTS)
    held = materialise_by(_keyed(groups, buckets), "snapshot-groups", "__bucket")

    def build(table):
        import pyarrow as pa

        seed, segment, segments, data = build_filter(np.unique(table["__key"].to_numpy().astype(np.uint64)))
        return pa.table({"__bucket": pa.array(table["__bucket"][:1].to_pylist(), pa.int32()), "__seed": [seed], "__segment": pa.array([segment], pa.int32()), "__segments": pa.array([segments], pa.int32()), "__data": [data]})

    schema = "__bucket int, __seed bigint, __segment int, __segments int, __data binary"
    filters = held.select("__bucket", "__key").groupBy("__bucket").applyInArrow(build, schema)
    return Snapshot(held, materialise(filters, "snapshot-filters"), buckets)


def screen(groups: DataFrame, snap: Snapshot) -> DataFrame:
    """__bucket and __digest of groups that the snapshot's filters let through: all that it has, and 1 in 256 of the others.

    A bucket's incoming digests are cut into pieces of about BUCKET_DIGESTS, each beside a copy of the filter.
    """
    pieces = max(1, -(-groups.count() // (snap.buckets * BUCKET_DIGESTS)))

    def ask(incoming, filters):
        import pyarrow as pa

        if filters.num_rows and incoming.num_rows:
            f = filters.to_pylist()[0]
            hit = in_filter(incoming["__key"].to_numpy().astype(np.uint64), f["__seed"], f["__segment"], f["__segments"], f["__data"])
        else:
            hit = np.zeros(incoming.num_rows, bool)
        return incoming.select(["__bucket", "__digest"]).filter(pa.array(hit))

    incoming = _keyed(groups, snap.buckets).select("__bucket", "__key", "__digest", F.pmod(F.hash("__digest"), F.lit(pieces)).alias("__piece"))
    filters = snap.filters.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    return incoming.groupBy("__bucket", "__piece").cogroup(filters.groupBy("__bucket", "__piece")).applyInArrow(ask, "__bucket int, __digest binary")


def matches(groups: DataFrame, snap: Snapshot) -> DataFrame:
    """The groups whose digest the snapshot has: what the filters let through joins the exact digests of its bucket."""
    maybe = materialise(screen(groups, snap), "batch-positives")
    found = materialise(groups.join(maybe.join(snap.groups.select("__bucket", "__digest"), ["__bucket", "__digest"]).select("__digest"), "__digest", "left_semi"), "batch-matches")
    discard(maybe)
    return found


def stacked(batches: list[DataFrame]) -> DataFrame:
    """Each digest of the batches once, with its size and best document: a stack of snapshots, one for each batch's new digests."""
    names = ["__digest", "__size", "__best"]
    snaps: list[Snapshot] = []
    news, again = [], []
    for k, rows in enumerate(batches):
        groups = materialise(grouped(rows), "batch-groups")
        met = [matches(groups, s) for s in snaps]
        new = groups
        for m in met:
            new = new.join(m.select("__digest"), "__digest", "left_anti")
        if k < len(batches) - 1:
            new = materialise(new, "batch-new") if met else new
            snaps.append(snapshot(new))
        news.append(new.select(*names))
        again += [m.select(*names) for m in met]
    facts = reduce(DataFrame.unionByName, news)
    if not again:
        return facts
    # new digests stand as they are; those that later batches held again take their increments
    more = reduce(DataFrame.unionByName, again).groupBy("__digest").agg(F.sum("__size").alias("__more"), F.min("__best").alias("__other"))
    size, best = F.col("__size") + F.coalesce("__more", F.lit(0)), F.least("__best", F.coalesce("__other", "__best"))
    return facts.join(more, "__digest", "left").select("__digest", size.alias("__size"), best.alias("__best"))


def _by_ids(docs: DataFrame, ids: DataFrame, key, how: str) -> DataFrame:
    """docs joined with a materialised table of ids: broadcast when it is short, else shuffled."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """__id, __row, __n, __digest, __size, __best, __kept of every document, after byte checks; materialised.

    The table arrives as batches (dealt by a hash of the id): each is screened against the snapshots before it, and what
    is new becomes the next snapshot.
    """
    rows = materialise(digested(docs, id_col, text_col), "digests")
    batch = F.pmod(F.crc32(F.coalesce(F.col("__id").cast("string"), F.lit("")).cast("binary")), F.lit(batches))
    groups = materialise(stacked([rows.filter(batch == b) for b in range(batches)]), "groups")
    joined = split_join(rows, groups.withColumn("__held", F.col("__size")), "__digest", "__held", rows.count()).withColumn("__of", F.lit(0))
    joined = materialise(joined.withColumn("__kept", (F.col("__best.row") == F.col("__row"))), "classes")
    wrong = _unequal(docs, joined, id_col, text_col)
    if not wrong.isEmpty():  # two texts of one digest: their text itself parts them
        joined = _parted(docs, joined, wrong, id_col, text_col)
    discard(rows, groups)
    return joined


def _key(column):
    """An id to join by; null is the empty text, which no number is."""
    return F.coalesce(column.cast("string"), F.lit(""))


def _unequal(docs: DataFrame, joined: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Digests whose documents differ in their normalised text.

    Only documents of groups of several are read again, found by id. A group's least and greatest text are compared;
    every task sends one pair of them for a group, however many members it holds.
    """
    several = materialise(joined.filter("__size > 1").select(_key(F.col("__id")).alias("__i")), "several")
    texts = _by_ids(docs.select(_key(F.col(id_col)).alias("__i"), normal(F.col(text_col)).alias("__text")), several, "__i", "left_semi")
    ends = texts.groupBy(F.unhex(F.sha2("__text", 256)).alias("__digest")).agg(F.min("__text").alias("__low"), F.max("__text").alias("__high"))
    wrong = materialise(ends.filter("__low <> __high").select("__digest"), "collisions")
    discard(several)
    return wrong


def _parted(docs: DataFrame, joined: DataFrame, wrong: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Groups of a digest shared by different texts, parted by text."""
    texts = docs.select(F.col(id_col).alias("__i"), normal(F.col(text_col)).alias("__text")).withColumn("__d", F.unhex(F.sha2("__text", 256)))
    texts = texts.join(wrong.withColumnRenamed("__digest", "__d"), "__d", "left_semi").distinct()
    marked = joined.drop("__size", "__best", "__kept", "__of").join(texts, (F.col("__digest") == F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i")), "left").drop("__d", "__i")
    marked = materialise(marked, "parted")
    groups = marked.groupBy("__digest", F.coalesce("__text", F.lit("")).alias("__of")).agg(F.count(F.lit(1)).alias("__size"), _best().alias("__best"))
    out = marked.withColumn("__of", F.coalesce("__text", F.lit(""))).drop("__text").join(groups, ["__digest", "__of"])
    return materialise(out.withColumn("__kept", (F.col("__best.row") == F.col("__row"))), "classes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    return classes(docs, id_col, text_col, batches).select(
        F.col("__id").alias(id_col), F.col("__best.id").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__kept").alias("kept"), F.lower(F.hex("__digest")).alias("text_sha256")
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """docs, all columns, without the documents that an equal one stays for.

    Dropped rows are taken out by id. Where ids repeat, the digest joins the id, and rows equal in both are reduced to one.
    """
    found = classes(docs, id_col, text_col, batches)
    key = _key(F.col(id_col))
    if found.groupBy("__id").count().filter("count > 1").isEmpty():
        gone = materialise(found.filter(~F.col("__kept")).select(_key(F.col("__id")).alias("__i")), "dropped")
        return _by_ids(docs.withColumn("__i", key), gone, "__i", "left_anti").select(*docs.columns)
    named = found.select(_key(F.col("__id")).alias("__i"), F.col("__digest").alias("__d"), "__kept")
    dropped, stays = named.filter(~F.col("__kept")).drop("__kept").distinct(), named.filter("__kept").drop("__kept")
    twice = materialise(dropped.join(stays, ["__i", "__d"], "left_semi"), "repeated")  # the same id and text as the one that stays
    gone = materialise(dropped.join(twice, ["__i", "__d"], "left_anti"), "dropped")
    rows = docs.withColumn("__i", key).withColumn("__d", F.unhex(F.sha2(normal(F.col(text_col)), 256)))
    rows = _by_ids(rows, gone, ["__i", "__d"], "left_anti")
    again = _by_ids(rows, twice, ["__i", "__d"], "left_semi").dropDuplicates(["__i", "__d"])
    return _by_ids(rows, twice, ["__i", "__d"], "left_anti").unionByName(again).select(*docs.columns)
