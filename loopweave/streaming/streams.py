"""Streaming forms: the aligner as a stateless map over files of sequences that arrive, and quotas that carry on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.config import Motif, Scoring, Thresholds
from ..operators.align import align_repeats
from ..operators.intervals import by_interval
from ..sources.text import IUPAC_TO_N


def fasta_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """(seq_ordinal, name, nt) of FASTA files that appear in a folder; ordinals are hashes of file and name."""
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder)
    text = F.regexp_replace("value", "^>", "")
    name = F.regexp_extract(text, r"^\s*(\S+)", 1)
    body = F.translate(F.regexp_replace(F.regexp_replace(text, "^[^\n]*\n?", ""), "\n", ""), *IUPAC_TO_N)
    return raw.filter(F.length("value") > 0).select(F.xxhash64(F.input_file_name(), name).alias("seq_ordinal"), name.alias("name"), F.upper(body).alias("nt"))


def align_stream(sequences: DataFrame, motifs: list[str | Motif], scoring: Scoring, limits: Thresholds) -> DataFrame:
    """The batch aligner on a stream: sequences are independent, so no state and no watermark is needed."""
    return align_repeats(sequences, motifs, scoring, limits)


class _Quota(StatefulProcessor):
    """Takes rows of an interval until its quota is met; the state is how many were taken and seen."""

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(STATE, "taken bigint, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        taken, seen = self.state.get() if self.state.exists() else (0, 0)
        held = None
        for part in rows:
            seen += len(part)
            left = int(part["quota__"].iloc[0]) - taken if len(part) else 0
            if left > 0:
                # of a batch the lowest hashes are taken: what is held never exceeds what is left of the quota
                held = (part if held is None else pd.concat([held, part])).nsmallest(left, "hash__")
        if held is not None:
            taken += len(held)
            yield held[self.columns]
        self.state.update((taken, seen))

    def close(self) -> None:
        pass


#: The name of the state variable, and the provider that it needs.
STATE = "quota"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def quota_stream(rows: DataFrame, spec: DataFrame, length: str = "length", key: list[str] | None = None, seed: int = 0) -> DataFrame:
    """A stream of rows, with lo and hi, sampled to the quotas of spec (lo, hi, out_count), which carry over from batch to batch.

    What is taken and seen of an interval is keyed state of the query, kept in its checkpoint: a query that is started
    again goes on where it stopped, and neither the sink nor earlier rows are read. Of a batch the rows with the lowest
    hashes of their key (default: all columns) are taken. A task holds at most what is left of an interval's quota. The
    session's state store must be RocksDB (PROVIDER).
    """
    wanted = spec.select("lo", "hi", F.col("out_count").alias("quota__"))
    placed = by_interval(rows, wanted, F.col(length)).withColumn("hash__", F.xxhash64(F.lit(seed), *(key or rows.columns)))
    columns = [*rows.columns, "lo", "hi"]
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return placed.groupBy("lo", "hi").transformWithStateInPandas(_Quota(columns), schema, "append", "none")


def quota_left(spark: SparkSession, spec: DataFrame, checkpoint: str) -> DataFrame:
    """The specification (lo, hi, out_count, in_count) that is left after a stream's last batch, from its checkpointed state.

    More rows in an interval than the specification expects is an error.
    """
    state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    got = state.select(F.col("key.lo").alias("lo"), F.col("key.hi").alias("hi"), "value.taken", "value.seen")
    out = spec.join(got, ["lo", "hi"], "left").fillna(0, ["taken", "seen"])
    left = F.col("in_count") - F.col("seen")
    checked = F.when(left < 0, F.raise_error(F.lit("more rows than the specification expects")).cast("long")).otherwise(left)
    return out.select("lo", "hi", (F.col("out_count") - F.col("taken")).alias("out_count"), checked.alias("in_count"))
