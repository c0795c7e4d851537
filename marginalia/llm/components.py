"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import discard, materialise, split_join


#: So many edges are joined without looking for hot centres: their plan would cost more than their rows.
FEW = 100_000


def _star(edges: DataFrame, total: int) -> DataFrame:
    """u and the least of u and its neighbours, beside every neighbour v of u; total: how many edges there are at most."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")).select("u", F.least("u", "m").alias("m"), "k")
    if total < FEW:
        return edges.join(least, "u").select("u", "v", "m")
    return split_join(edges, least, "u", "k", total).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """v and label for every vertex of edges(u, v): the least vertex that links lead to. Vertices may be of any ordered type.

    Every round writes its edges into the shared folder, so a lost executor costs no earlier round, and removes those of
    the round before; hot centres are joined by a broadcast. The number of rounds follows the logarithm of the longest path.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, total = None, now.count()
    while True:
        large = _star(both(now), 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down, total)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        last, now = now, materialise(small.filter("u <> v").distinct(), "edges")
        discard(last)
        # a fixed point is a set of stars: no vertex is both a leaf and a centre, and the edges stay
        then, mark = mark, now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        total = mark["n"]
        if then == mark:
            break
    leaves = now.select(F.col("u").alias("v"), F.col("v").alias("label"))
    return leaves.unionByName(now.select(F.col("v"), F.col("v").alias("label"))).distinct()
