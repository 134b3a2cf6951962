"""Helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder, set from spark.checkpoint.dir if need be; only in local mode a temporary one where neither is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"cairn-{uuid.uuid4().hex}"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, in the folder that the cluster names in spark.checkpoint.dir."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder and read back. Computed once, where a checkpoint computes its last stage twice.

    A checkpoint keeps what the optimiser knew of its rows; over the rounds of a loop with joins and aliases these constraints double each
    time, until planning takes longer than the work. Written rows start afresh.
    """
    spark = df.sparkSession
    place = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def sent(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df for a join, stored, and sent whole to every task if it has `most` rows at most: the other side stays where it lies."""
    rows = stored(df)
    return F.broadcast(rows) if rows.count() <= most else rows


def top(df: DataFrame, k: int, by: list[str], *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in a total order, with their rank; planned with a per-partition group limit before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)
