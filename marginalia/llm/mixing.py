"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its share of the target weights times the corpus' characters over the
source's own characters. Each document inverts a hash-seeded Poisson distribution with that mean, is
exploded by its count and shuffled globally by a hash of (document, copy).

Defined results: a null source is a source of its own; a source without characters is measured by rows so
that empty texts have a rate too; null texts count as empty and are replicated as they are. Repeated rows
draw the same count. Columns mix_rate, mix_copy and mix_key replace columns of the same name in any case;
all other columns are kept. An empty table gives an empty table. Weight 0 leaves a source out.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import materialise, without

#: Largest mean that one inversion takes; a larger one is a sum of independent draws.
LARGEST_MEAN = 16.0
#: Entries of a cumulative table: beyond them less than 2**-60 is left for any mean up to LARGEST_MEAN.
TABLE = 72
#: A source table up to this many rows (each under 1 KB) is broadcast; a longer one is joined by a salted shuffle.
BROADCAST_SOURCES = 2_000
SALTS = 32
#: 52 bits of the hash make the uniform number.
DIGITS = 13


def _uniform(seed: int, *parts):
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(float(2 ** (4 * DIGITS)))


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, default_weight: float, epochs: float, source_col: str, text_col: str) -> DataFrame:
    """source, rate, draws and the cumulative Poisson table of one draw, for each source."""
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("__s").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sums = docs.select(F.col(source_col).cast("string").alias("__s"), F.coalesce(F.length(text_col), F.lit(0)).cast("bigint").alias("__n")).groupBy("__s")
    sums = sums.agg(F.greatest(F.sum("__n"), F.count(F.lit(1))).alias("__size")).withColumn("__w", weight)
    sums = materialise(sums, "source-sizes")
    total = sums.agg(F.sum("__size").alias("all"), F.sum("__w").alias("ws")).first()
    share = F.col("__w") / F.lit(float(total["ws"])) if total["ws"] else F.lit(0.0)
    rated = sums.select("__s", (share * F.lit(float(total["all"] or 0)) * F.lit(float(epochs)) / F.col("__size")).alias("__rate"))
    rated = rated.withColumn("__draws", F.greatest(F.ceil(F.col("__rate") / LARGEST_MEAN), F.lit(1)).cast("int"))
    mean = F.col("__rate") / F.col("__draws")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE)),
        start,
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c")),
        lambda a: a["c"],
    )
    return rated.withColumn("__cdf", cdf)


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """docs replicated to the target weights, shuffled: all columns, and mix_rate, mix_copy (from 0), mix_key.

    weights: target share by source, in any unit; default_weight for the others. Rows are dealt to
    partitions by the random key and sorted by it there, which is a uniform permutation without a sampling
    pass. The join with the rates broadcasts them if their count is at most BROADCAST_SOURCES, else both
    sides are salted so that a hot source is spread over SALTS tasks.
    """
    docs = without(docs, "mix_rate", "mix_copy", "mix_key", "__s", "__rate", "__draws", "__cdf", "__salt")
    columns = docs.columns
    rates = source_rates(docs, weights, default_weight, epochs, source_col, text_col)
    keyed = docs.withColumn("__s", F.col(source_col).cast("string"))
    few = rates.count() <= BROADCAST_SOURCES
    if few:
        joined = keyed.join(F.broadcast(rates), keyed["__s"].eqNullSafe(rates["__s"]))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int"))
        joined = keyed.join(salted, (keyed["__salt"] == salted["__salt"]) & keyed["__s"].eqNullSafe(salted["__s"]))
    # the number is bound once: inside the inner function it would be hashed again for each entry
    draw = lambda i: F.transform(F.array(_uniform(seed, F.col(id_col), i)), lambda u: F.size(F.filter(F.col("__cdf"), lambda c: c <= u)))[0]
    one = draw(F.lit(1))
    many = F.aggregate(F.sequence(F.lit(1), F.col("__draws")), F.lit(0), lambda a, i: a + draw(i))
    count = F.when(F.col("__draws") == 1, one).otherwise(many)
    copies = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    out = joined.select(*[docs[c] for c in columns], F.col("__rate").alias("mix_rate"), F.explode(copies).alias("mix_copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("mix_copy")))
    return out.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")


def poisson_inverse(mean: float, u: float) -> int:
    """The inversion of one draw in plain Python, for tests."""
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k <= TABLE:
        k += 1
        p *= mean / k
        c += p
    return k
