"""Settling what is read more than once, and what may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    A folder of our own is made only where the session names none and runs on one machine, as in tests.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loopweave-checkpoint-"))
    return named or sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder, compressed, and read from there: computed once, and only wanted columns are read."""
    df.write.parquet(path := f"{shared_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df settled by a reliable checkpoint in the shared folder, its order kept."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def few(df: DataFrame) -> DataFrame:
    """df, computed once; to be broadcast if its rows, written out, are measured to have at most BROADCAST_BYTES."""
    df = settle(df)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df
