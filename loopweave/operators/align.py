"""Finding repeats: the aligner over DataFrames, and what is computed from alignments column by column.

Sequences are rows (seq_ordinal, name, nt); motifs a small table made by `motif_frame`. Alignments are rows of
ALIGNMENT. No exchange is needed before a sink, as sequences are independent.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..functions.config import Motif, Scoring, Thresholds, parse_motif
from ..functions.loop_align import dense_intervals, error_clumps, search

ALIGNMENT = (
    "seq_ordinal bigint, name string, seq_len int, motif_ordinal int, motif_name string, motif string, strand string, emit_ordinal int, "
    "score int, start int, end int, seq_bases int, motif_bases int, m int, mm int, i int, d int, match_ratio float, seq_text string, motif_text string, excised boolean"
)
#: Bases of the sequences that are searched together in a task: many, as a step costs about the same for few segments and for many.
TOGETHER = 1 << 24
#: Cells of the recurrence, bases times motif bases, in a part of a sequence's motifs that is dealt out on its own.
PART = 1 << 26


def _parsed(motifs: list[str | Motif]) -> list[Motif]:
    return [m if isinstance(m, Motif) else parse_motif(m) for m in motifs]


def prefilter(sequences: DataFrame, min_sequence: int = 0, skip: int = 0, head: int | None = None) -> DataFrame:
    """Sequences long enough, from the skip-th ordinal on (itself kept) up to the head-th; goes below the aligner."""
    kept = sequences
    if min_sequence > 0:
        kept = kept.filter(F.length("nt") >= min_sequence)
    if skip:
        kept = kept.filter(F.col("seq_ordinal") >= skip)
    return kept if head is None else kept.filter(F.col("seq_ordinal") <= head)


#: Lengths of words by which pairs of a sequence and a motif are told apart before the aligner.
GRAMS = range(2, 13)


def gram_rule(motif: Motif, limits: Thresholds) -> tuple[int, int, int] | None:
    """(q, least, width): a sequence in which this motif is reported has, in one of its blocks of `width` bases, at
    least `least` places of words of q bases of the looped motif. None: there is no useful such rule.

    What is reported has m matches and e errors with m / (m + e) at the ratio r or above, and at least min_length
    columns, so m >= r * min_length and e <= m * (1 - r) / r. The matches lie in e + 1 runs at most, so at least
    m - (q - 1) * (e + 1) words of q bases come through. They span m / r bases at most and touch m / (r * width) + 2
    blocks at most, each border of which cuts q - 1 words at most; the fullest block has no less than the mean, which
    grows with m.
    """
    ratio, length = float(limits.min_ratio or 0) - 1e-6, limits.min_length
    if ratio <= 0.5 or any(set(x or "") - set("ACGT") for x in (motif.forward, motif.reverse)):
        return None
    m, best = ratio * length, None
    for q in GRAMS:
        share = 1 - (q - 1) * (1 - ratio) / ratio
        least = math.ceil(share * m / (m / (ratio * length) + 2) - (q - 1) - 1e-9)
        by_chance = length * min(1.0, len(motif.forward) / 4**q)
        if least > 2 * by_chance and (best is None or least / (by_chance + 1) > best[0]):
            best = least / (by_chance + 1), q, least
    return best and (best[1], best[2], length)


def motif_words(motif: str, q: int) -> list[str]:
    """The words of q bases of an endlessly repeated motif."""
    looped = motif * (q // len(motif) + 2)
    return sorted({looped[k : k + q] for k in range(len(motif))})


def likely_motifs(sequences: DataFrame, motifs: list[str | Motif], limits: Thresholds, strands: str = "both") -> DataFrame:
    """sequences with `likely`, the ordinals of those motifs that can be reported in them at all; built-in expressions.

    Lossless: see `gram_rule`. The rules are data, one literal array, so many motifs make no larger plan.
    """
    rules, widths = [], set()
    for k, m in enumerate(_parsed(motifs)):
        rule = gram_rule(m, limits)
        sides = [x for x, wanted in ((m.forward, strands != "reverse"), (m.reverse, strands != "forward")) if x and wanted]
        words = [f"(?=(?:{'|'.join(motif_words(x, rule[0]))}))" if rule else "" for x in sides] or [""]
        rules.append({"k": k, "least": rule[1] if rule else 0, "one": words[0], "other": words[-1]})
        widths |= {rule[2]} if rule else set()
    if not widths:
        return sequences.withColumn("likely", F.sequence(F.lit(0), F.lit(len(rules) - 1)) if rules else F.array().cast("array<int>"))
    table = F.from_json(F.lit(json.dumps(rules)), "array<struct<k:int,least:int,one:string,other:string>>")
    has = lambda b, r: (r["least"] == 0) | (F.regexp_count(b, r["one"]) >= r["least"]) | ((r["other"] != r["one"]) & (F.regexp_count(b, r["other"]) >= r["least"]))
    blocks = F.regexp_extract_all(F.upper("nt"), F.lit(f"(?s).{{1,{widths.pop()}}}"), F.lit(0))
    likely = dna.let(blocks, lambda x: F.transform(F.filter(table, lambda r: F.exists(x, lambda b: has(b, r))), lambda r: r["k"]))
    return sequences.withColumn("likely", F.coalesce(likely, F.array().cast("array<int>")))


def dealt(sequences: DataFrame, motifs: list[Motif]) -> DataFrame:
    """sequences (nt, likely, ...) with a row for each part of its motifs that costs about PART cells."""
    every = F.sequence(F.lit(0), F.lit(len(motifs) - 1)) if motifs else F.array().cast("array<int>")
    likely = F.coalesce("likely", every)
    longest = max([len(m.forward) for m in motifs], default=1)
    size = F.greatest(F.lit(1), F.floor(F.lit(PART) / (F.greatest(F.length("nt"), F.lit(1)) * longest))).cast("int")
    parts = F.sequence(F.lit(0), F.ceil(F.size(likely) / size).cast("int") - 1)
    cut = F.when(F.size(likely) > 0, F.transform(parts, lambda k: F.slice(likely, k * size + 1, size)))
    return sequences.withColumn("likely", F.explode(cut))


def align_repeats(
    sequences: DataFrame, motifs: list[str | Motif], scoring: Scoring, limits: Thresholds, strands: str = "both", excised: bool = False, partitions: int | None = None,
    grams: bool = True,
) -> DataFrame:
    """Repeats of each motif in each sequence, by sequence, motif and order of emission.

    excised: also the error clumps that were cut out (excised is true), which are searched again but not reported.
    partitions: deal the work out anew: the motifs of a sequence in parts of about PART cells of the recurrence, and
    the parts by a hash. Wanted if a few files hold very unequal sequences, or a sequence meets very many motifs; a
    sequence moves once for each of its parts. Ordinals tell the order of rows in any case.
    grams: pairs of a sequence and a motif that cannot be reported are left out before they reach the aligner; the
    rows are the same with and without.
    """
    parsed = _parsed(motifs)
    columns = sequences.select("seq_ordinal", "name", "nt")
    if grams:
        columns = likely_motifs(columns, parsed, limits, strands).filter(F.size("likely") > 0)
    else:
        columns = columns.withColumn("likely", F.lit(None).cast("array<int>"))
    if partitions:
        columns = dealt(columns, parsed).repartition(partitions, F.xxhash64("seq_ordinal", "name", "likely"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2] or "")
                if size >= TOGETHER:
                    yield _aligned(rows, parsed, scoring, limits, strands, excised)
                    rows, size = [], 0
        if rows:
            yield _aligned(rows, parsed, scoring, limits, strands, excised)

    return columns.mapInArrow(run, ALIGNMENT)


def _aligned(rows: list[tuple], motifs: list[Motif], scoring: Scoring, limits: Thresholds, strands: str, excised: bool) -> pa.RecordBatch:
    tasks = [(ordinal, name, nt or "", k, motifs[k]) for ordinal, name, nt, likely in rows for k in (range(len(motifs)) if likely is None else likely)]
    results = search([t[2] for t in tasks], [(t[4].forward, t[4].reverse) for t in tasks], scoring, limits, strands)
    out = []
    for (ordinal, name, nt, k, motif), found in zip(tasks, results, strict=True):
        emitted = 0
        for a, cut in found:
            if cut and not excised:
                continue
            out.append(
                (ordinal, name, len(nt), k, motif.name, motif.forward, a.strand, emitted, a.score, a.start, a.end, a.seq_bases, a.motif_bases,
                 a.m, a.mm, a.i, a.d, float(a.match_ratio), a.seq_text, a.motif_text, cut)
            )
            emitted += 1
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "float": pa.float32(), "boolean": pa.bool_()}
    fields = [f.strip().split() for f in ALIGNMENT.split(",")]
    columns = list(zip(*out, strict=True)) if out else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def on_texts(df: DataFrame, function, schema: str) -> DataFrame:
    """df (seq_text, motif_text, ...) with the column `result` of function(seq_text, motif_text), in Arrow batches."""
    out = df.withColumn("result", F.lit(None).cast(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, q = b.column(b.schema.get_field_index("seq_text")).to_pylist(), b.column(b.schema.get_field_index("motif_text")).to_pylist()
            values = [None if x is None or y is None else function(x, y) for x, y in zip(s, q, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, wanted)], names=[*b.schema.names, "result"])

    wanted = {"int": pa.int32(), "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}[schema]
    return df.mapInArrow(run, out.schema)


def find_clumps(df: DataFrame, rate: float, min_length: int) -> DataFrame:
    """df with `clumps`: stretches of at least min_length columns with errors at the rate or more, as intervals of columns."""
    return on_texts(df, lambda s, q: [{"start": a, "end": b} for a, b in error_clumps([x == y for x, y in zip(s, q, strict=True)], rate, min_length)], "array<struct<start:int,end:int>>").withColumnRenamed("result", "clumps")


def dense_columns(df: DataFrame, ratio: float) -> DataFrame:
    """df with `dense`: maximal intervals of columns all of whose prefixes and suffixes have the match ratio."""
    r = np.float32(ratio)
    return on_texts(df, lambda s, q: [{"start": a, "end": b} for a, b in dense_intervals([x == y for x, y in zip(s, q, strict=True)], r)], "array<struct<start:int,end:int>>").withColumnRenamed("result", "dense")


def rescore(df: DataFrame, scoring: Scoring) -> DataFrame:
    """df with `rescored`, by built-in expressions."""
    return df.withColumn("rescored", dna.rescore(dna.column_kinds(F.col("seq_text"), F.col("motif_text")), scoring))


def slice_columns(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """df with seq_text and motif_text cut to the columns left to right, and start moved by the bases before."""
    n = right - left
    gone = F.length(F.regexp_replace(F.substr("seq_text", F.lit(1), left), "-", ""))
    cut = df.withColumn("start", F.col("start") + gone)
    for c in ("seq_text", "motif_text"):
        cut = cut.withColumn(c, F.substr(c, left + 1, n))
    return cut.withColumn("end", F.col("start") + F.length(F.regexp_replace("seq_text", "-", "")))


def clump_mask(df: DataFrame) -> DataFrame:
    """df with `mask`: the match mask with the columns of `clumps` drawn as *."""
    mask = F.split(dna.match_mask(F.col("seq_text"), F.col("motif_text")), "")
    inside = lambda i: F.exists("clumps", lambda c: (i >= c["start"]) & (i < c["end"]))
    return df.withColumn("mask", F.array_join(F.transform(mask, lambda x, i: F.when(inside(i), "*").otherwise(x)), ""))


def motif_phase(motif: Column, motif_text: Column, whole: bool = False) -> Column:
    """struct(position, direction): the rotation of the motif, else of its reverse complement, that the text follows.

    Up to one copy of the motif at the text's start decides, or the whole text; null if no rotation agrees.
    """
    text = F.upper(F.regexp_replace(motif_text, "-", ""))
    text = text if whole else F.substr(text, F.lit(1), F.length(motif))
    # a text follows a rotation if its start does and if it repeats itself after each copy of the motif
    n = F.length(motif)
    start = F.substr(text, F.lit(1), n)
    loops = (F.length(text) <= n) | (F.substr(text, n + 1) == F.substr(text, F.lit(1), F.length(text) - n))

    def first(m: Column, direction: str) -> Column:
        at = F.instr(F.concat(m, m), start)
        return F.when((at > 0) & (at <= n) & loops, F.struct((at - 1).alias("position"), F.lit(direction).alias("direction")))

    return F.coalesce(first(motif, "+"), first(dna.reverse_complement(motif), "-"))


def positional_events(alignments: DataFrame, keys: list[str], phase: Column | None = None) -> DataFrame:
    """(keys, pos, nuc, m, mm, i, d, mm_a, mm_c, mm_g, mm_t): events at each position of the motif, per alignment.

    A map over the alignments, without an exchange: each is counted where it is, by numpy. Keys need not be unique.
    alignments: keys, motif, strand, seq_text, motif_text. A column belongs to the motif base at it, an insertion to
    the base that follows. Texts that follow the reverse complement count positions backwards; mismatched bases of
    alignments on the reverse strand are complemented. A text that follows neither counts forward from 0. A phase
    that is known otherwise, such as that of a noiseless genome, can be given.
    """
    zero = F.struct(F.lit(0).alias("position"), F.lit("+").alias("direction"))
    known = F.coalesce(phase if phase is not None else motif_phase(F.col("motif"), F.col("motif_text"), whole=True), zero)
    base = alignments.select(*keys, "motif", "strand", "seq_text", "motif_text", known.alias("phase"))
    rows = F.arrow_udf(_positions_of, POSITIONS)("seq_text", "motif_text", "motif", "strand", F.col("phase.position"), F.col("phase.direction"))
    out = base.select(*keys, "motif", F.inline(rows))
    return out.select(*keys, "pos", F.substr("motif", F.col("pos") + 1, F.lit(1)).alias("nuc"), *COUNTS)


COUNTS = ("m", "mm", "i", "d", "mm_a", "mm_c", "mm_g", "mm_t")


def position_counts(seq_text: str, motif_text: str, n: int, reverse_strand: bool, first: int, forward: bool) -> np.ndarray:
    """Counts (n positions of the motif, COUNTS) of the columns of one alignment."""
    s, q = np.frombuffer(seq_text.encode("latin-1", "replace"), np.uint8), np.frombuffer(motif_text.encode("latin-1", "replace"), np.uint8)
    inserted, deleted = q == 45, s == 45
    kind = np.where(inserted, 2, np.where(deleted, 3, np.where(s == q, 0, 1)))
    ahead = np.concatenate([[0], np.cumsum(~inserted)[:-1]]) if len(q) else np.zeros(0, np.int64)
    at = (first + ahead) % n
    at = at if forward else n - 1 - at
    counts = np.zeros((n, len(COUNTS)), np.int64)
    counts[:, :4] = np.bincount(at * 4 + kind, minlength=4 * n).reshape(n, 4)
    for k, base in enumerate(b"TGCA" if reverse_strand else b"ACGT"):
        counts[:, 4 + k] = np.bincount(at[(kind == 1) & (s == base)], minlength=n)
    return counts


POSITIONS = f"array<struct<pos:int,{','.join(f'{c}:bigint' for c in COUNTS)}>>"


def _positions_of(seq_text: pa.Array, motif_text: pa.Array, motif: pa.Array, strand: pa.Array, first: pa.Array, direction: pa.Array) -> pa.Array:
    places, parts, sizes = [], [], [0]
    for s, q, m, t, f, d in zip(*(c.to_pylist() for c in (seq_text, motif_text, motif, strand, first, direction)), strict=True):
        counts = position_counts(s, q, len(m), t == "-", f, d == "+") if s and m else np.zeros((0, len(COUNTS)), np.int64)
        used = np.flatnonzero(counts[:, :4].any(axis=1))
        places.append(used.astype(np.int32))
        parts.append(counts[used])
        sizes.append(sizes[-1] + len(used))
    table = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *parts])
    columns = [pa.array(np.concatenate([np.zeros(0, np.int32), *places])), *(pa.array(table[:, k]) for k in range(len(COUNTS)))]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, names=["pos", *COUNTS]))


def mx_matrix(positional: DataFrame, keys: list[str], n_positions: int, less_insertions: bool = False) -> DataFrame:
    """One row per alignment: matches m0.. and errors x0.. of each motif position (0 where there is no column).

    less_insertions: insertions are taken from the matches, as each spoils the match that it stands before.
    """
    wide = positional.groupBy(*keys)
    cell = lambda k, c: F.coalesce(F.sum(F.when(F.col("pos") == k, c)), F.lit(0)).cast("long")
    errors = F.col("mm") + F.col("i") + F.col("d")
    matches = F.col("m") - F.col("i") if less_insertions else F.col("m")
    return wide.agg(*[cell(k, matches).alias(f"m{k}") for k in range(n_positions)], *[cell(k, errors).alias(f"x{k}") for k in range(n_positions)])


def crc_bytes(data: bytes) -> int:
    """CRC-32 with the usual polynomial, but starting from 0 and without the final inversion."""
    return zlib.crc32(data, 0xFFFFFFFF) ^ 0xFFFFFFFF


def alignment_crc(df: DataFrame) -> DataFrame:
    """df with `crc`: the check value of name, strand, start, motif and both texts, as eight hexadecimal digits."""
    out = df.withColumn("crc", F.lit("").cast("string"))
    names = ("name", "strand", "start", "motif", "seq_text", "motif_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]
            values = []
            for name, strand, start, motif, s, q in zip(*columns, strict=True):
                data = name.encode() + strand.encode() + int(start).to_bytes(4, "big") + (motif + s + q).encode()
                values.append(f"{crc_bytes(data):08X}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.string())], names=[*b.schema.names, "crc"])

    return df.mapInArrow(run, out.schema)
