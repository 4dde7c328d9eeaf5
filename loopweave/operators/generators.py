"""Generators and simulators: variates, mock genomes with truth, errors, reads, random cigars, parameter balls.

Every row's draws come from a generator seeded by the row, so results don't depend on partitions or order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import reverse_complement_text
from ..functions.formula import formula

BASES = "ACGT"


def random_normal(spark: SparkSession, n: int, mu: float, sigma: float, seed: int, rounding: str | None = None, digits: int | None = None) -> DataFrame:
    """(id, x): normal variates; rounding: round, floor or ceil to an integer, or digits after the point."""
    x = F.randn(seed) * sigma + mu
    if rounding:
        x = {"round": F.round, "floor": F.floor, "ceil": F.ceil}[rounding](x).cast("long")
    elif digits is not None:
        x = F.round(x, digits)
    return spark.range(n, numPartitions=max(1, min(64, n // 100_000 + 1))).select("id", x.alias("x"))


def random_sequence(rng: np.random.Generator, n: int) -> str:
    return "".join(np.array(list(BASES))[rng.integers(0, 4, n)])


def neighbors(motif: str) -> list[str]:
    """Every substitution, insertion and deletion of one base, repeats included, as `dna.motif_neighbors` has them."""
    ends = [(motif[:k], motif[k:]) for k in range(len(motif) + 1)]
    swapped = [a + base + b[1:] for a, b in ends if b for base in BASES if base != b[0]]
    return swapped + [a + base + b for a, b in ends for base in BASES] + [a + b[1:] for a, b in ends if b]


def neighbor(rng: np.random.Generator, motif: str) -> str:
    """One of the neighbors of a motif, all alike likely."""
    return str(rng.choice(neighbors(motif)))


@dataclass(frozen=True)
class Errors:
    """Rates of mismatch, insertion and deletion for each base."""

    mm: float = 0.0
    i: float = 0.0
    d: float = 0.0


def mock_genome(
    name: str, length: int, arrays: list[tuple[int, str]], seed: int, errors: Errors | None = None, min_fill: int = 0, varied: float = 0.0, mixed: float = 0.0
) -> tuple[str, list[dict]]:
    """(nucleotides, catalog) of one chromosome: repeat arrays (length, motif) in order, at random places in random fill.

    The fill around arrays has `length` bases in all, at least min_fill between arrays. Each array has a random strand
    and phase; with probability `varied` its motif is one edit away, and with probability
    `mixed` its copies are of the motif or of one a single edit away, half and half (A,B in the catalog). With errors, bases become other bases, get a
    base before them or go, and the catalog counts the events and follows the coordinates.
    """
    rng = np.random.default_rng(seed)
    spare = length - min_fill * max(len(arrays) - 1, 0)
    if spare < 0:
        raise ValueError("not enough fill for the arrays")
    marks = np.sort(rng.integers(0, spare + 1, len(arrays)))
    pieces, catalog, at = [], [], 0
    done = 0
    for k, (n, motif) in enumerate(arrays):
        fill = int(marks[k]) - done + (min_fill if k else 0)
        done = int(marks[k])
        pieces.append(random_sequence(rng, fill))
        at += fill
        u = rng.random()
        units = [neighbor(rng, motif)] if u < varied else [motif, neighbor(rng, motif)] if u < varied + mixed else [motif]
        strand = "+-"[int(rng.integers(0, 2))]
        phase = int(rng.integers(0, len(units[0])))
        array = _copies(rng, units if strand == "+" else [reverse_complement_text(x) for x in units], phase + n)[phase : phase + n]
        row = {"seq": name, "start": at, "motif": f"{','.join(units)}.{phase}{strand}", "rpt_len": n, "fill": fill, "m": n, "mm": 0, "i": 0, "d": 0}
        if errors:
            array, counts = with_errors(rng, array, errors)
            row |= counts
        pieces.append(array)
        at += len(array)
        catalog.append(row | {"end": at, "len": len(array)})
    pieces.append(random_sequence(rng, spare - done))
    return "".join(pieces), catalog


def _copies(rng: np.random.Generator, units: list[str], n: int) -> str:
    """At least n bases of copies, each of one of the units, all alike likely."""
    copies = n // min(len(x) for x in units if x) + 1 if any(units) else 0
    return "".join(np.array(units)[rng.integers(0, len(units), copies)])


def drawn_arrays(motifs: list[str], lengths: list[int], n: int, seed: int) -> list[tuple[int, str]]:
    """n arrays (length, motif), both drawn at random, for a chromosome of `mock_genome`."""
    rng = np.random.default_rng(seed)
    return [(int(lengths[b]), motifs[a]) for a, b in zip(rng.integers(0, len(motifs), n).tolist(), rng.integers(0, len(lengths), n).tolist(), strict=True)]


def with_errors(rng: np.random.Generator, nucs: str, e: Errors) -> tuple[str, dict]:
    """(sequence with errors, counts m, mm, i, d): each base is replaced, else preceded by a new one, else dropped."""
    u = rng.random((3, len(nucs)))
    other, new = rng.integers(1, 4, len(nucs)), rng.integers(0, 4, len(nucs))
    out, counts = [], {"m": 0, "mm": 0, "i": 0, "d": 0}
    for k, b in enumerate(nucs):
        if u[0, k] < e.mm:
            out.append(BASES[(BASES.index(b) + int(other[k])) % 4])
            counts["mm"] += 1
        elif u[1, k] < e.i:
            out.append(BASES[int(new[k])] + b)
            counts["i"] += 1
            counts["m"] += 1
        elif u[2, k] < e.d:
            counts["d"] += 1
        else:
            out.append(b)
            counts["m"] += 1
    return "".join(out), counts


def mock_genomes(specs: DataFrame, errors: Errors | None = None, min_fill: int = 0, varied: float = 0.0, mixed: float = 0.0) -> DataFrame:
    """One row for each of specs (name, length, arrays array<struct<length, motif>>, seed): name, nt and its catalog."""
    row = "struct<seq:string,start:bigint,`end`:bigint,motif:string,rpt_len:bigint,len:bigint,fill:bigint,m:bigint,mm:bigint,i:bigint,d:bigint>"
    order = ("seq", "start", "end", "motif", "rpt_len", "len", "fill", "m", "mm", "i", "d")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for s in pdf.itertuples(index=False):
                nt, catalog = mock_genome(s.name, int(s.length), [(int(a["length"]), a["motif"]) for a in s.arrays], int(s.seed), errors, min_fill, varied, mixed)
                out.append((s.name, nt, [{c: r[c] for c in order} for r in catalog]))
            yield pd.DataFrame(out, columns=["name", "nt", "catalog"])

    return specs.mapInPandas(run, f"name string, nt string, catalog array<{row}>")


def geometric(rng: np.random.Generator, extend: float) -> int:
    """A run's length: 1 and one more with probability `extend` each time."""
    return 1 if extend <= 0 else int(math.floor(1 + math.log(1 - rng.random()) / math.log(extend)))


def random_cigar(rng: np.random.Generator, read_len: int, ins_open: float, ins_extend: float, del_open: float, del_extend: float) -> tuple[list[tuple[int, str]], int]:
    """(operations, genome bases needed) of a read: matches and gaps in turn, no deletion at the ends."""
    ops: list[tuple[int, str]] = []
    left, genome, run = read_len, 0, 0
    while left > 0:
        u = rng.random()
        gap = "I" if u < ins_open else "D" if u < ins_open + del_open else ""
        if gap == "D" and not ops and not run:
            gap = ""
        if not gap:
            run, left, genome = run + 1, left - 1, genome + 1
            continue
        if run:
            ops.append((run, "M"))
            run = 0
        n = geometric(rng, ins_extend if gap == "I" else del_extend)
        if gap == "I":
            n = min(n, left)
            left -= n
        else:
            genome += n
        ops.append((n, gap))
    if run:
        ops.append((run, "M"))
    joined: list[tuple[int, str]] = []
    for kind, group in itertools.groupby(ops, key=lambda o: o[1]):
        joined.append((sum(n for n, _ in group), kind))
    return joined, genome


def apply_cigar(rng: np.random.Generator, genome: str, ops: list[tuple[int, str]]) -> str:
    """The read that a cigar makes of genome bases, with random inserted bases."""
    out, at = [], 0
    for n, op in ops:
        if op == "M":
            out.append(genome[at : at + n])
        elif op == "I":
            out.append(random_sequence(rng, n))
        at += n if op in "MD" else 0
    return "".join(out)


def segments_without(nucs: str, run: int) -> list[tuple[int, int]]:
    """Stretches of a sequence between runs of at least `run` Ns (half-open); the last one always counts."""
    out, start, k = [], 0, 0
    while k < len(nucs):
        if nucs[k] in "Nn":
            end = k
            while end < len(nucs) and nucs[end] in "Nn":
                end += 1
            if end - k >= run:
                if k > start:
                    out.append((start, k))
                start = end
            k = end
        else:
            k += 1
    if len(nucs) > start:
        out.append((start, len(nucs)))
    return out


@dataclass(frozen=True)
class ReadModel:
    length: int
    substitution: float = 0.0
    ins_open: float = 0.0
    ins_extend: float = 0.0
    del_open: float = 0.0
    del_extend: float = 0.0
    n_run: int = 10


def sample_reads(
    spark: SparkSession, genome: list[tuple[str, str]], n: int, model: ReadModel, seed: int = 0, lengths: list[int] | None = None, strand: str | None = None,
    weights: dict[str, float] | None = None, prefix: str = "READ_",
) -> DataFrame:
    """n reads (read, nt, seq, strand, g_start, g_end, cigar) from chromosomes (name, nt), uniform over placements.

    Placements are those in stretches without long N runs that are long enough, those of a chromosome as likely as its
    weight says (1 unless given); both strands are equally likely unless one is given. lengths cycle if given. A read
    that fits nowhere is an error. The genome travels with the tasks; LARGEST_GENOME bases at most.
    """
    places, text = _places(genome, model.n_run)
    share = np.array([(weights or {}).get(name, 1.0) for name, _, _ in places])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, int(k)])
                length = lengths[int(k) % len(lengths)] if lengths else model.length
                ops, need = random_cigar(rng, length, model.ins_open, model.ins_extend, model.del_open, model.del_extend)
                room = np.array([max(0, e - s - need + 1) for _, s, e in places])
                odds = np.cumsum(room * share)
                if not len(odds) or not odds[-1]:
                    raise ValueError(f"a read of {need} genome bases fits nowhere")
                which = int(np.searchsorted(odds, rng.random() * odds[-1], side="right"))
                name, s, _ = places[which]
                start = s + int(rng.integers(0, room[which]))
                side = strand or "+-"[int(rng.integers(0, 2))]
                piece = text[name][start : start + need].upper()
                piece = reverse_complement_text(piece) if side == "-" else piece
                read, _ = with_errors(rng, apply_cigar(rng, piece, ops), Errors(mm=model.substitution))
                out.append((f"{prefix}{k}", read, name, side, start, start + need, "".join(f"{c}{o}" for c, o in ops)))
            yield pd.DataFrame(out, columns=["read", "nt", "seq", "strand", "g_start", "g_end", "cigar"])

    return spark.range(n).mapInPandas(run, "read string, nt string, seq string, strand string, g_start bigint, g_end bigint, cigar string")


#: Bases of a genome that travels with the tasks.
LARGEST_GENOME = 100_000_000


def _places(genome: list[tuple[str, str]], n_run: int) -> tuple[list[tuple[str, int, int]], dict[str, str]]:
    """Stretches (name, start, end) without long N runs, and the chromosomes' texts."""
    if sum(len(nt) for _, nt in genome) > LARGEST_GENOME:
        raise ValueError(f"a genome of more than {LARGEST_GENOME:,} bases can't travel with the tasks")
    return [(name, s, e) for name, nt in genome for s, e in segments_without(nt, n_run)], dict(genome)


def step_reads(genome: DataFrame, length: int, step: int, n_run: int = 10) -> DataFrame:
    """Reads (read, nt, seq, strand, g_start, g_end) of a length at every `step` of each stretch without long N runs.

    genome: (name, nt). Each chromosome is walked where it lies; the last read of a stretch ends inside it.
    """
    stretches = F.regexp_extract_all(F.regexp_replace("nt", f"[Nn]{{{n_run},}}", "\n"), F.lit("[^\n]+"), F.lit(0))
    gaps = F.regexp_extract_all("nt", F.lit(f"[Nn]{{{n_run},}}"), F.lit(0))
    ahead = F.length(F.regexp_extract("nt", f"^([Nn]{{{n_run},}})", 1))
    # a stretch starts after those before it and the runs between
    run_before = lambda i: F.when(ahead > 0, F.get(gaps, i)).otherwise(F.get(gaps, F.greatest(i - 1, F.lit(0))))
    sizes = F.transform(stretches, lambda x, i: F.struct(x.alias("nt"), F.when((i > 0) | (ahead > 0), F.length(run_before(i))).otherwise(0).alias("gap")))
    placed = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,nt:string>>").alias("all")),
        lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["nt"])).alias("at"), F.concat(a["all"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), x["nt"].alias("nt")))).alias("all")),
    )["all"]
    rows = genome.select(F.col("name").alias("seq"), F.inline(placed)).withColumnRenamed("nt", "stretch").filter(F.length("stretch") >= length)
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.length("stretch") - length, F.lit(step))))
    start = (F.col("start") + F.col("_at")).cast("long")
    return rows.select(
        F.concat_ws("_", "seq", start.cast("string")).alias("read"), F.upper(F.substr("stretch", F.col("_at") + 1, F.lit(length))).alias("nt"), "seq", F.lit("+").alias("strand"),
        start.alias("g_start"), (start + length).alias("g_end"),
    )


def sample_pairs(spark: SparkSession, genome: list[tuple[str, str]], n: int, model: ReadModel, insert_mu: float, insert_sigma: float, orientation: str = "H2H", seed: int = 0) -> DataFrame:
    """n read pairs (pair, mate, nt, seq, strand, start, end) at normal insert lengths, three tries each.

    orientation: T2T, H2H, H2T or T2H, which ends the mates turn to each other. Each mate has its own interval. A pair
    none of whose three inserts fits is left out.
    """
    places, text = _places(genome, model.n_run)
    turns = {"T2T": ("-", "+"), "H2H": ("+", "-"), "H2T": ("+", "+"), "T2H": ("-", "-")}[orientation]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, 1, int(k)])
                for _ in range(3):
                    insert = int(round(rng.normal(insert_mu, insert_sigma)))
                    room = np.array([max(0, e - s - insert + 1) for _, s, e in places])
                    if insert < model.length or not room.sum():
                        continue
                    at = int(rng.integers(0, room.sum()))
                    which = int(np.searchsorted(np.cumsum(room), at, side="right"))
                    name, s, _ = places[which]
                    start = s + at - int(room[:which].sum())
                    for mate, (a, strand) in enumerate(((start, turns[0]), (start + insert - model.length, turns[1])), 1):
                        nt = text[name][a : a + model.length].upper()
                        nt = reverse_complement_text(nt) if strand == "-" else nt
                        out.append((int(k), mate, with_errors(rng, nt, Errors(mm=model.substitution))[0], name, strand, a, a + model.length))
                    break
            yield pd.DataFrame(out, columns=["pair", "mate", "nt", "seq", "strand", "start", "end"])

    return spark.range(n).mapInPandas(run, "pair bigint, mate int, nt string, seq string, strand string, start bigint, `end` bigint")


def weighted_choice(weights: list[float], n: int, seed: int) -> np.ndarray:
    """n indexes drawn with the given weights."""
    p = np.array(weights, float)
    return np.random.default_rng(seed).choice(len(p), size=n, p=p / p.sum())


def parameter_ball(
    spark: SparkSession, center: dict[str, int], radius: int, reject: str | None = None, sample: int | None = None, spikes: bool = False, keep_center: bool = True, seed: int = 0
) -> DataFrame:
    """Integer points around a center: all within radius in every coordinate, or only along single axes (spikes).

    reject is a formula over the coordinates; points where it holds go. sample: that many points, without repeats, by a
    hash of the point.
    """
    names = list(center)
    if spikes:
        rows = {tuple(center[m] + (k if m == name else 0) for m in names) for name in names for k in range(-radius, radius + 1)}
        df = spark.createDataFrame(sorted(rows), ", ".join(f"`{n}` long" for n in names))
    else:
        axis = lambda n: F.explode(F.sequence(F.lit(center[n] - radius), F.lit(center[n] + radius)))
        df = spark.range(1).select()
        for n in names:
            df = df.select("*", axis(n).alias(n)).withColumn(n, F.col(n).cast("long"))
    if reject:
        df = df.filter(~F.coalesce(formula(reject, {n: F.col(n) for n in names}), F.lit(False)))
    if not keep_center:
        away = F.lit(False)
        for n, c in center.items():
            away = away | (F.col(n) != c)
        df = df.filter(away)
    return df if sample is None else df.orderBy(F.xxhash64(F.lit(seed), *names), *names).limit(sample)
