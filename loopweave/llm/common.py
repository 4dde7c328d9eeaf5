"""What the training-data operators share: table access, checkpoints and native text expressions."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (space, \t, \n, \v, \f, \r) that parts words.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, set for checkpoints if nothing has done so.

    A folder of our own is made only where the session names none and runs on one machine, as in tests; on a cluster
    that is an error. What is written there is left to the cluster's clean-up.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loopweave-checkpoint-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables that are written to the shared folder and read from there, in place of checkpoints, and dropped together.

    They are computed once, compressed, and a plan reads only the columns that it needs of them.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame) -> DataFrame:
        df.write.parquet(path := f"{shared_folder(self.spark)}/settled-{uuid.uuid4().hex}")
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Deletes the tables; nothing may read them any more."""
        sc = self.spark.sparkContext
        for path in self.paths:
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there; it stays until the cluster's clean-up."""
    return Scratch(df.sparkSession).settle(df)


def few(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """df, computed once; to be broadcast if its rows, written out, are measured to have at most BROADCAST_BYTES."""
    df = (scratch or Scratch(df.sparkSession)).settle(df)
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def let(value: Column, body) -> Column:
    """body(value) with value computed once.

    Catalyst may copy an expression into each place that uses it, even into a lambda that runs per element; as the
    element of a one-row array it is bound to a variable and evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters left alone."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents (crc32 of the id as text, mod 5 = 0) from which no label is learned."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
