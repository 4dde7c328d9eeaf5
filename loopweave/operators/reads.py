"""Alignments of simulated reads rebuilt from cigars, sliced by genome intervals, and scoring-set tables."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .align import positional_events
from .durable import few, settle
from .intervals import overlap_join


def with_cigars(reads: DataFrame, cigars: DataFrame) -> DataFrame:
    """Reads (read, nt) with their cigar rows; a read without one is an error, cigars without a read are ignored."""
    joined = reads.join(cigars, "read", "left")
    missing = F.raise_error(F.concat(F.lit("no cigar for read "), F.col("read"))).cast("string")
    return joined.withColumn("cigar", F.when(F.col("cigar").isNull(), missing).otherwise(F.col("cigar")))


#: Bases of a chunk of a stored sequence.
CHUNK = 1 << 16


def chunked(sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """Sequences (name, nt) as a table of chunks (seq, chunk, seq_len, chunk_nt), each of `size` bases but the last.

    Each sequence has a chunk 0, also an empty one. Written as a table it is a store from which stretches of a sequence
    are put together without the rest of it. A sequence is walked once, whatever its length.
    """
    parts = F.regexp_extract_all("nt", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    parts = F.when(F.length("nt") == 0, F.array(F.lit(""))).otherwise(parts)
    return sequences.filter("nt is not null").select(F.col("name").alias("seq"), F.length("nt").cast("long").alias("seq_len"), F.posexplode(parts).alias("chunk", "chunk_nt"))


def stretches(wanted: DataFrame, chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """wanted (seq, g_start, g_end, ...) with `nt`, the bases from g_start to g_end of its sequence, from a table of chunks.

    A row meets only the chunks that it touches and takes its own bases of each, so what moves on from there grows with
    the rows wanted, not with their sequences. What lies outside a sequence is left out; rows of a sequence that the
    store hasn't are left out.
    """
    lengths = few(chunks.filter("chunk = 0").select(F.col("seq").alias("_s"), "seq_len"))
    known = wanted.join(lengths, F.col("seq") == F.col("_s")).drop("_s")
    low = F.greatest(F.lit(0), F.least("g_start", "seq_len")).cast("long")
    known = known.withColumn("_lo", low).withColumn("_hi", F.greatest(F.col("_lo"), F.least("g_end", "seq_len"))).drop("seq_len")
    known = settle(known.withColumn("_id", F.monotonically_increasing_id()))
    last = F.greatest(F.col("_lo"), F.col("_hi") - 1)
    touching = known.filter("_hi > _lo").select("_id", F.col("seq").alias("_s"), "_lo", "_hi", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(last / size))).alias("_c"))
    met = touching.join(chunks.select("seq", "chunk", "chunk_nt"), (F.col("_s") == F.col("seq")) & (F.col("_c") == F.col("chunk")))
    first = F.greatest(F.lit(0), F.col("_lo") - F.col("_c") * size)
    end = F.least(F.lit(size), F.col("_hi") - F.col("_c") * size)
    pieces = met.select("_id", "_c", F.substr("chunk_nt", (first + 1).cast("int"), (end - first).cast("int")).alias("_p"))
    whole = pieces.groupBy(F.col("_id").alias("_i")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_c", "_p"))), lambda x: x["_p"]), "").alias("nt"))
    out = known.join(whole, F.col("_id") == F.col("_i"), "left")
    return out.withColumn("nt", F.coalesce("nt", F.lit(""))).drop("_id", "_i", "_lo", "_hi")


def genome_pieces(reads: DataFrame, genome: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Reads (seq, strand, g_start, g_end, ...) with g_nt, the genome bases under them along the read's strand.

    genome: sequences (name, nt); chunks: the same as a table of `chunked`, if there is one already.
    """
    own = reads.drop("g_nt").withColumnRenamed("nt", "_nt")
    found = stretches(own, chunked(genome) if chunks is None else chunks).withColumnRenamed("nt", "g_nt").withColumnRenamed("_nt", "nt")
    return found.withColumn("g_nt", F.when(F.col("strand") == "-", dna.reverse_complement(F.col("g_nt"))).otherwise(F.col("g_nt")))


def gapped(nt: str, g_nt: str, cigar: str) -> tuple[str, str] | None:
    """(read, genome) texts of an alignment by its cigar, mismatched genome bases in lower case; None if it doesn't fit."""
    read, genome, r, g = [], [], 0, 0
    for n, op in re.findall(r"(\d+)\s*([MID])", cigar):
        n = int(n)
        read.append("-" * n if op == "D" else nt[r : r + n])
        genome.append("-" * n if op == "I" else g_nt[g : g + n])
        r, g = r + (op != "D") * n, g + (op != "I") * n
    if (r, g) != (len(nt), len(g_nt)):
        return None
    a, b = (np.frombuffer("".join(x).encode("latin-1", "replace"), np.uint8) for x in (read, genome))
    differ = (a != b) & (a != 45) & (b != 45) & (b >= 65) & (b <= 90)
    return "".join(read), np.where(differ, b | 32, b).astype(np.uint8).tobytes().decode("latin-1")


def reconstruct(reads: DataFrame) -> DataFrame:
    """Reads (nt, g_nt, cigar, ...) with r_text and g_text, the gapped alignment; mismatched genome bases in lower case.

    A cigar that doesn't use up both sequences is an error. One pass over each read, in Arrow batches.
    """

    def texts(nt: pa.Array, g_nt: pa.Array, cigar: pa.Array) -> pa.Array:
        found = [None if None in x else gapped(*x) for x in zip(nt.to_pylist(), g_nt.to_pylist(), cigar.to_pylist(), strict=True)]
        return pa.array([f and {"r": f[0], "g": f[1]} for f in found], pa.struct([("r", pa.string()), ("g", pa.string())]))

    out = reads.withColumn("_a", F.arrow_udf(texts, "struct<r:string,g:string>")("nt", "g_nt", "cigar"))
    bad = F.raise_error(F.concat(F.lit("cigar does not fit read "), F.col("read"))).cast("string")
    return out.withColumn("r_text", F.when(F.col("_a").isNotNull(), F.col("_a.r")).otherwise(bad)).withColumn("g_text", F.col("_a.g")).drop("_a")


def slice_by_genome(alignments: DataFrame, intervals: DataFrame) -> DataFrame:
    """Pieces of alignments (read, seq, strand, g_start, g_end, r_text, g_text) over the intervals that they touch.

    Columns read, seq, start and end (of the piece on the genome), r_start, r_end, r_text, g_text, as the read runs.
    A piece begins at the first column whose genome position is at or past the interval's start.
    """
    genome = alignments.select("seq", F.col("g_start").alias("start"), F.col("g_end").alias("end"), "read", "strand", "r_text", "g_text")
    pairs = overlap_join(genome, intervals.select("seq", "start", "end"))
    minus = F.col("strand") == "-"
    r, g = (F.when(minus, dna.reverse_complement(F.col(c))).otherwise(F.col(c)) for c in ("r_text", "g_text"))
    pairs = pairs.withColumn("_r", r).withColumn("_g", g)

    def places(g_text: pa.Array, start: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        """Columns from the first whose genome position is at or past low up to that of high, and the position of the first."""
        rows = []
        for text, at, lo, hi in zip(g_text.to_pylist(), start.to_pylist(), low.to_pylist(), high.to_pylist(), strict=True):
            bases = np.frombuffer(text.encode("latin-1", "replace"), np.uint8) != 45
            position = at + np.concatenate([[0], np.cumsum(bases)])
            first, last = (int(np.searchsorted(position[: len(bases)], x)) for x in (lo, hi))
            rows.append({"first": first, "last": last, "at": int(position[first])})
        return pa.array(rows, pa.struct([("first", pa.int32()), ("last", pa.int32()), ("at", pa.int64())]))

    found = F.arrow_udf(places, "struct<first:int,last:int,at:bigint>")("_g", "start", "right_start", "right_end")
    pairs = pairs.withColumn("_p", found).withColumn("_from", F.col("_p.first")).withColumn("_to", F.col("_p.last"))
    cut = lambda c: F.substr(c, F.col("_from") + 1, F.col("_to") - F.col("_from"))
    bases = lambda c: F.length(F.regexp_replace(c, "-", ""))
    before, whole = bases(F.substr("_r", F.lit(1), F.col("_from"))), bases(F.col("_r"))
    pairs = pairs.withColumn("_rt", cut("_r")).withColumn("_gt", cut("_g")).withColumn("_before", before)
    g_start = F.col("_p.at")
    back = lambda c: F.when(minus, dna.reverse_complement(F.col(c))).otherwise(F.col(c))
    return pairs.select(
        "read", "seq", "strand", g_start.alias("start"), (g_start + bases(F.col("_gt"))).alias("end"),
        F.when(minus, whole - F.col("_before") - bases(F.col("_rt"))).otherwise(F.col("_before")).alias("r_start"),
        F.when(minus, whole - F.col("_before")).otherwise(F.col("_before") + bases(F.col("_rt"))).alias("r_end"),
        back("_rt").alias("r_text"), back("_gt").alias("g_text"),
    )


def genome_positional_events(pieces: DataFrame, motif: str, keys: list[str]) -> DataFrame:
    """Positional events of pieces (r_text, g_text, strand) of a noiseless genome: the phase is where the motif first occurs in it."""
    whole = F.upper(F.regexp_replace("g_text", "-", ""))
    at = F.instr(whole, F.lit(motif))
    n = len(motif)
    phase = F.when(at > 0, F.struct(F.pmod(-(at - 1), F.lit(n)).alias("position"), F.lit("+").alias("direction")))
    texts = pieces.withColumn("seq_text", F.col("r_text")).withColumn("motif_text", F.col("g_text")).withColumn("motif", F.lit(motif))
    return positional_events(texts, keys, phase)


def scoring_table(results: DataFrame, scorings: DataFrame) -> DataFrame:
    """Scoring sets (file, six scores) with their rates tpr and fdr to six decimals, numbered from 1, best rate first.

    A row for each scoring set that was tried, some thousands, so one task numbers them.
    """
    joined = scorings.join(results.select("file", F.format_string("%.6f", "tpr").alias("tpr"), F.format_string("%.6f", "fdr").alias("fdr")), "file")
    return joined.select(F.row_number().over(Window.orderBy(F.desc("tpr"), "file")).alias("number"), "*").orderBy("number")


def simulation_table(rates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Rates and metrics of simulations side by side, by number; a number that only one of them has is kept."""
    return rates.join(metrics, "simulation", "full_outer")
