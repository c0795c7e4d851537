"""Helpers that every corpus operator shares: the shared folder, materialised tables, hot keys, column hygiene.

Intermediate tables lie in marginalia/ below the shared folder. Operators remove those that their result does not
read; what a lazy result still reads stays until the folder of the run is removed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and U+0009 to U+000D.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset one of our own in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="marginalia-"))
    return spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginalia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _written(spark.read.schema(df.schema).parquet(path), path)


def _written(df: DataFrame, path: str) -> DataFrame:
    df._written = path
    return df


def materialise_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """The same with a folder for each value of a key, which must be few: reads of some values skip the other folders."""
    path = f"{shared_dir(df.sparkSession)}/marginalia/{name}-{uuid.uuid4().hex}"
    df.repartition(key).write.partitionBy(key).parquet(path)
    return _written(df.sparkSession.read.schema(df.schema).parquet(path), path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialised tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        if path := df.__dict__.pop("_written", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, in any case, so that an operator can add its own."""
    taken = {n.lower() for n in names}
    return df.select([df[c] for c in df.columns if c.lower() not in taken])


#: A key with more than 1 / HOT of a table's rows (and LEAST_HOT of them) is hot: there are at most HOT such keys.
HOT, LEAST_HOT = 4096, 256
#: Tables of fewer rows are joined without looking for hot keys.
SMALL = 4096


def hot_rows(total: int) -> int:
    """Rows that make a key of a table of total rows hot."""
    return max(LEAST_HOT, -(-total // HOT))


def split_join(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with facts (one row for each key; n: how many of the total rows have it), hot keys apart.

    Facts of hot keys, HOT of them at most, are broadcast, so that their rows stay where they are; all others meet by a
    shuffle. Null keys join nothing.
    """
    if total < SMALL:
        return rows.join(facts.drop(n), key)
    hot = facts.filter(F.col(n) >= hot_rows(total)).drop(n)
    here = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.filter(F.col(n) < hot_rows(total)).drop(n), key)
    return here.unionByName(rest)


def most_frequent(counts: DataFrame, value: str, n: str, most: int) -> tuple[list, list[int]]:
    """Values of counts, the most frequent first, and their counts: at most most of them, all of any frequency class taken whole.

    Frequencies are counted in sixteenths of an octave first, so the driver gets about a thousand numbers and then
    no more than most rows (as Arrow columns, without a Python object for each row), however many tasks there are.
    """
    counts = materialise(counts.select(value, n, F.floor(F.log2(F.col(n).cast("double")) * 16).cast("int").alias("__class")), "counts")
    least, room = None, most
    for r in counts.groupBy("__class").count().orderBy(F.desc("__class")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["__class"]
    if least is None:
        discard(counts)
        return [], []
    found = counts.filter(F.col("__class") >= least).select(value, n).toArrow().sort_by([(n, "descending"), (value, "ascending")])
    discard(counts)
    return found[value].to_pylist(), found[n].to_pylist()
