"""Bounded samples of labelled documents, and the optimiser that the trained operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import _written, materialise


#: Labels that a classifier may have.
MOST_LABELS = 200


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def balanced_ids(rows: DataFrame, label: str, most: int, id_col: str) -> list[tuple]:
    """(id, label) of at most most rows, the labels as evenly as they come, chosen by a hash of the id.

    Null ids and labels are left out. The driver gets the counts of at most MOST_LABELS labels and about most rows; more
    labels are an error, as one classifier cannot tell so many apart.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(label).alias("y")).na.drop()
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().limit(MOST_LABELS + 1).collect()}
    if not counts:
        return []
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {label}")
    each = max(1, most // len(counts))
    spread = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30))
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == F.lit(y), F.lit(min(1.0, 1.2 * each / n + 16 / n))).otherwise(share)
    found = sorted((r["h"], r["id"], r["y"]) for r in rows.withColumn("h", spread).filter(F.col("h") < share * (1 << 30)).collect())
    kept, out = dict.fromkeys(counts, 0), []
    for _, i, y in found:
        if kept[y] < each:
            kept[y] += 1
            out.append((i, y))
    return out


def labelled_texts(docs: DataFrame, chosen: list[tuple], id_col: str, text_col: str, id_type: str) -> DataFrame:
    """y, text of the chosen documents; the list is bounded by the sample size and broadcast."""
    ids = docs.sparkSession.createDataFrame(chosen, f"__i {id_type}, y int")
    return docs.select(F.col(id_col).alias("__i"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "__i").select("__i", "y", "text")


def sample_table(texts: DataFrame, most: int, most_bytes: int | None = None) -> DataFrame:
    """key, id (hashes), y, text of texts(__i, y, text) that are learned from: whole texts, written once.

    Rows are taken in the order of a hash of id and text, so whatever the tasks and their order are, the same ones are
    taken; a row that repeats counts once. At most 2 * most rows, and of each label whole texts of at most its share of
    most_bytes (a longer one is left out; the shortest is taken where none fits).
    """
    rows = materialise(texts.withColumn("key", F.xxhash64("__i", "text")).dropDuplicates(["key"]).select("key", F.xxhash64("__i").alias("id"), "y", "text"), "sample")
    sizes = rows.select("key", "y", F.octet_length("text").alias("n")).orderBy("key", "y").limit(2 * most).collect()
    room = {y: (most_bytes or 0) // len({r["y"] for r in sizes}) for y in {r["y"] for r in sizes}}
    kept, labels = [], set()
    for r in sizes:
        if most_bytes is None or r["n"] <= room[r["y"]]:
            room[r["y"]] -= r["n"]
            kept.append(r["key"])
            labels.add(r["y"])
    kept += [min((r["n"], r["key"]) for r in sizes if r["y"] == y)[1] for y in sorted(set(room) - labels)]
    return _written(rows.join(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in kept], "key bigint")), "key", "left_semi"), rows._written)


class Adam:
    """Adam over a dictionary of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01, decay: float = 0.0):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        a, b = 1 - 0.9**self.t, 1 - 0.999**self.t
        for k, g in grads.items():
            g = g + self.decay * self.p[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / a) / (np.sqrt(self.v[k] / b) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
