"""Tables staged between steps that read them more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder and read from there: its lineage is cut, and what reads it
    several times plans it once. In local mode without such a folder, one of our own is made."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stareflow-"))
    path = f"{sc.getCheckpointDir()}/staged/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df to be joined by a shuffle. Left to itself, Spark broadcasts what is small when compressed, and millions of
    short rows are: the driver then holds them all."""
    return df.hint("merge")
