"""Document fingerprints: SimHash over weighted words, and permuted block tables for Hamming search.

Each word's 64-bit hash votes on 64 signed bits with a weight that grows with the word's length, so function
words count little and repeats add up. Two bit counters share one long (bit j and bit j + 32), so 32
sums hold all votes and whole-stage code keeps them in registers; no array is built per document.

Defined results: null text counts as empty; a text without words has fingerprint 0. Equal texts have equal
fingerprints. Neighbours follow descending id; repeated ids follow each other by text, null ids come last;
a single document is its own neighbour. Columns beside id and text are not read. Empty table: no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from marginalia.llm.common import materialise, partitions, split_join

BITS = 64
#: A word of n code points weighs min(n, LONGEST) - LIGHT, at least 1.
LONGEST, LIGHT = 16, 3
#: Rows of a bucket are neighbours by id; so many buckets for each shuffle partition.
BUCKETS = 2
#: Block keys of queries up to this many (about 1 MB) are broadcast; more meet the tables by a shuffle.
BROADCAST_KEYS = 20_000


def _votes(word):
    """Weight of a word (0 for an empty one) and its 32 packed votes."""
    weight = F.when(F.length(word) == 0, F.lit(0)).otherwise(F.greatest(F.least(F.length(word), F.lit(LONGEST)) - LIGHT, F.lit(1))).cast("bigint")
    return weight, F.xxhash64(word)


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys and __fp (bigint): the fingerprint of each row's text. keys must tell rows apart."""
    words = texts.select(*keys, F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09-\x0D]+")).alias("__word"))
    weight, code = _votes(F.col("__word"))
    words = words.select(*keys, weight.alias("__w"), code.alias("__h"))
    lane = F.lit((1 << 32) | 1)
    sums = [F.sum(F.shiftrightunsigned("__h", j).bitwiseAND(lane) * F.col("__w")).alias(f"__s{j}") for j in range(BITS // 2)]
    summed = words.groupBy(*keys).agg(F.sum("__w").alias("__all"), *sums)
    bits = F.lit(0).cast("bigint")
    for j in range(BITS // 2):
        low, high = F.col(f"__s{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"__s{j}", 32)
        bits = bits.bitwiseOR(F.when(low * 2 > F.col("__all"), F.lit(1 << j).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        top = (1 << (j + 32)) - (1 << 64 if j == 31 else 0)
        bits = bits.bitwiseOR(F.when(high * 2 > F.col("__all"), F.lit(top).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return summed.select(*keys, bits.alias("__fp"))


def as_text(fingerprint):
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def likeness(a, b):
    """1 less the share of bits that differ."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)).cast("double") / F.lit(float(BITS))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__bucket, __id, __text, __next, __end: each document's text and that of the next by descending id (after the last, the first).

    Ids are cut into buckets at quantiles, each bucket goes to a partition of its own, and a window orders it; the first
    document of the next bucket below stands at its end (__end = 1), so no task sees more than a bucket and one row. The
    driver gets one id per bucket.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("__k"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    )
    n = partitions(spark) * BUCKETS
    cuts = sorted(set(base.select(F.col("__k").cast("double")).approxQuantile("__k", [i / n for i in range(1, n)], 0.2 / n)))
    # bounds as integers; a double of a large id is rounded, which moves a bound but not the order
    bounds = sorted({int(c) for c in cuts})
    bucket = F.size(F.filter(F.array(*[F.lit(b).cast("bigint") for b in bounds]), lambda b: b <= F.col("__k"))) if bounds else F.lit(0)
    base = base.withColumn("__bucket", bucket.cast("int"))
    tops = sorted((r["__bucket"], r["top"]) for r in base.groupBy("__bucket").agg(F.max("__k").alias("top")).collect())
    if not tops:
        return base.select("__bucket", "__id", "__text", F.col("__text").alias("__next"), F.lit(0).alias("__end"))
    above = {top: tops[i + 1][0] for i, (_, top) in enumerate(tops[:-1])}  # the first of a bucket follows the last of the one above
    above[tops[-1][1]] = tops[0][0]
    to = F.create_map(*[F.lit(x).cast(t) for k, b in above.items() for x, t in ((k, "bigint"), (b, "int"))])
    sentinels = base.filter(F.col("__k").isin([F.lit(k).cast("bigint") for k in above])).withColumn("__bucket", to[F.col("__k")])
    both = base.withColumn("__end", F.lit(0)).unionByName(sentinels.withColumn("__end", F.lit(1))).repartitionById(len(bounds) + 1, "__bucket")
    order = W.partitionBy("__bucket").orderBy("__end", F.col("__k").desc(), "__text")
    return both.withColumn("__next", F.lead("__text").over(order)).select("__bucket", "__id", "__text", "__next", "__end")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of the text with its later half replaced by the next document's start, and likenesses.

    A text and its edited form are fingerprinted once each; the next document's fingerprint is the next row's.
    """
    half = F.floor(F.length("__text") / 2).cast("int")
    rows = with_next(docs, id_col, text_col).withColumn("__row", F.monotonically_increasing_id())
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), F.length("__text") - half), F.substring(F.col("__next"), F.lit(1), half))
    rows = rows.withColumn("__edited", F.when(F.col("__end") == 0, edited))
    facts = F.named_struct(F.lit("id"), F.col("__id"), F.lit("n"), F.length("__text").cast("bigint"), F.lit("sha"), F.unhex(F.sha2("__edited", 256)))
    # the bucket stays among the keys: rows are dealt by it already, so that both aggregations need no shuffle
    form = lambda i, c: F.named_struct(F.lit("__form"), F.lit(i), F.lit("__t"), F.col(c))
    texts = F.when(F.col("__end") == 0, F.array(form(0, "__text"), form(1, "__edited"))).otherwise(F.array(form(0, "__text")))
    forms = rows.select("__bucket", "__row", "__end", facts.alias("__facts"), F.inline(texts))
    keys = ["__bucket", "__row", "__end", "__facts"]
    prints = fingerprints(forms, [*keys, "__form"], "__t")
    pick = lambda i: F.max(F.when(F.col("__form") == i, F.col("__fp")))
    wide = prints.groupBy(*keys).agg(pick(0).alias("__own"), pick(1).alias("__edit"))
    # rows are numbered in the window's order
    wide = wide.withColumn("__after", F.lead("__own").over(W.partitionBy("__bucket").orderBy("__row"))).filter("__end = 0")
    return wide.select(
        F.col("__facts.id").alias(id_col),
        F.col("__facts.n").alias("n_chars"),
        F.lower(F.hex("__facts.sha")).alias("edited_sha256"),
        as_text(F.col("__own")).alias("fingerprint"),
        as_text(F.col("__edit")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__edit")).alias("near_edited"),
        likeness(F.col("__own"), F.col("__after")).alias("near_next"),
    )


def block_keys(fingerprint, radius: int, blocks: int):
    """One key for each choice of blocks - radius of the blocks: two fingerprints within the radius share one at least."""
    width = BITS // blocks
    bounds = [(i * width, BITS if i == blocks - 1 else (i + 1) * width) for i in range(blocks)]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (bounds[b][1] - bounds[b][0])) - 1) << bounds[b][0] for b in chosen)
        mask -= (1 << 64) if mask >> 63 else 0
        keys.append(F.named_struct(F.lit("table"), F.lit(t), F.lit("key"), fingerprint.bitwiseAND(F.lit(mask).cast("bigint"))))
    return F.array(*keys)


def find_near(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6, fp_col: str = "fp") -> DataFrame:
    """Pairs of distinct fingerprints (query_fp, near_fp, distance) within the Hamming radius, equal ones included.

    Both sides are first reduced to distinct fingerprints, so copies meet once; callers join members back by
    fingerprint. Null fingerprints match nothing. Every pair within the radius is found: two fingerprints that differ in
    radius bits agree in blocks - radius blocks at least, and each choice of so many blocks is a table.
    """
    tabled = lambda df, name: df.select(F.col(fp_col).alias(name)).na.drop().distinct().select(name, F.inline(block_keys(F.col(name), radius, blocks)))
    asked = materialise(tabled(queries, "query_fp"), "block-tables")
    pairs = tabled(prints, "near_fp").join(F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked, ["table", "key"])
    distance = F.bit_count(F.col("query_fp").bitwiseXOR(F.col("near_fp")))
    return pairs.withColumn("distance", distance).filter(F.col("distance") <= radius).select("query_fp", "near_fp", "distance").distinct()


def near_counts(rows: DataFrame, asks, radius: int = 3, blocks: int = 6, fp_col: str = "fingerprint", to: str = "near_documents") -> DataFrame:
    """rows with the number of rows whose fingerprint (as text) lies within the radius, itself included; null where asks is not true.

    rows must be materialised: they are read several times.
    """
    number = F.conv(F.col(fp_col), 16, -10).cast("bigint")
    held = rows.withColumn("__fp", number)
    of = materialise(held.groupBy("__fp").agg(F.count(F.lit(1)).alias("__held")), "fingerprints")
    found = find_near(of, held.filter(asks), radius, blocks, "__fp")
    pairs = found.join(of.select(F.col("__fp").alias("near_fp"), F.col("__held").alias("__near")), "near_fp")
    counts = materialise(pairs.groupBy(F.col("query_fp").alias("__fp")).agg(F.sum("__near").alias(to)).join(of, "__fp"), "near-counts")
    asked = split_join(held.filter(asks), counts, "__fp", "__held", rows.count()).select(*rows.columns, to)
    return asked.unionByName(rows.filter(~F.coalesce(asks, F.lit(False))).withColumn(to, F.lit(None).cast("bigint")))
