"""Tables that are computed once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df written to the folder that spark.checkpoint.dir names, its lineage cut: a lost executor costs nothing that came before.

    Where the setting is absent a temporary folder is taken, in local mode only. Written as Parquet, since a checkpoint computes its last
    stage twice, once to count its rows and once to write them; only what Parquet can't hold, columns without a type, is checkpointed.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="marginalia-"))
    if "void" in df.schema.simpleString():
        return df.checkpoint()
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def made_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """df with a column that is computed once a row, however often it is used.

    A plain projection is merged into the filters and projections above it, which then compute it again at each use; a generator's
    output is not.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(column)).alias(name))


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt to all cores by a key: a table of few row groups is else worked on by as few tasks, however many texts it holds."""
    return df.repartition(by)
