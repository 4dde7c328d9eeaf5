"""Scoring presets, search thresholds and option parsing; all of it runs on the driver."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Scoring:
    """Match score and penalties of a local alignment with affine gaps; min_score rejects weaker alignments."""

    match: int = 1
    mismatch: int = 5
    insert_open: int = 5
    insert_extend: int = 5
    delete_open: int = 5
    delete_extend: int = 5
    min_score: int = 0


#: Match, mismatch, insert open and extend, delete open and extend of each preset.
PRESETS = {
    "default": Scoring(1, 5, 5, 5, 5, 5),
    "pacbio": Scoring(10, 35, 33, 21, 6, 28),
    "pacbio.v3": Scoring(10, 35, 33, 21, 6, 28),
    "pacbio.v2": Scoring(10, 51, 47, 59, 43, 23),
    "pacbio.v1": Scoring(6, 14, 7, 22, 12, 12),
    "nanopore": Scoring(10, 63, 51, 98, 27, 34),
    "nanopore.v3": Scoring(10, 63, 51, 98, 27, 34),
    "nanopore.v2": Scoring(10, 36, 33, 37, 37, 44),
    "nanopore.v1": Scoring(10, 74, 70, 99, 45, 30),
    "historical": Scoring(2, 5, 4, 11, 5, 5),
}

#: Mismatch, insertion and deletion rates of simulated reads. The two simulators of the field name the
#: first and third pacbio profile the other way round, so both are given under explicit names.
ERROR_PROFILES = {
    "pacbio.v1.genome": (0.0170, 0.0890, 0.0430),
    "pacbio.v3.genome": (0.0110, 0.0650, 0.0290),
    "pacbio": (0.0170, 0.0890, 0.0430),
    "nanopore": (0.0460, 0.0380, 0.0770),
}


def simple_scoring(match: int, error: int, min_score: int = 0) -> Scoring:
    """One penalty for every kind of error."""
    return Scoring(match, error, error, error, error, error, min_score)


@dataclass(frozen=True)
class Thresholds:
    """What a search accepts, derived from the requested match ratio in 32-bit floats, as boundary cases need.

    The aligner accepts a ratio a little lower than requested; debridging then trims to the requested one, and
    clumps are stretches with clearly more errors than it allows.
    """

    min_length: int
    min_ratio: np.float32
    debridge_ratio: np.float32
    clump_ratio: np.float32
    clump_length: int


def thresholds(
    min_length: int = 500,
    min_ratio: float | None = None,
    debridge: bool = True,
    debridge_diff: float = 0.02,
    declump: bool = True,
    clump_diff: float = 0.10,
    clump_length: int = 100,
) -> Thresholds:
    """Thresholds of a search; min_ratio None accepts any ratio and turns trimming off."""
    for name, x in (("debridge_diff", debridge_diff), ("clump_diff", clump_diff)):
        if not 0 < x < 1:
            raise ValueError(f"{name} must be between 0 and 1")
    if min_ratio is not None and not 0 <= min_ratio <= 1:
        raise ValueError("min_ratio must be between 0 and 1")
    asked = np.float32(min_ratio or 0.0)
    trimmed = asked if debridge else np.float32(0)
    accepted = np.float32(asked - np.float32(debridge_diff)) if debridge and asked else asked
    clump = np.float32(1) - (trimmed - np.float32(clump_diff)) if declump and trimmed > 0 else np.float32(0)
    return Thresholds(max(int(min_length), 1), accepted, trimmed, np.float32(clump), clump_length)


COMPLEMENT = str.maketrans("ACGTSWRYMKBDHVNacgtswrymkbdhvn", "TGCASWYRKMVHDBNtgcaswyrkmvhdbn")


def reverse_complement_text(nucs: str) -> str:
    """Reverse complement with IUPAC codes, case kept and other characters left alone."""
    return nucs[::-1].translate(COMPLEMENT)


@dataclass(frozen=True)
class Motif:
    name: str
    forward: str
    reverse: str | None  # None if the motif is its own reverse complement


def parse_motif(arg: str) -> Motif:
    """[<name>:]<motif>; a leading colon leaves the motif unnamed, so that it is named by its bases."""
    name, colon, nucs = arg.partition(":")
    if not colon:
        name, nucs = "", arg
    nucs = nucs.upper()
    if not re.fullmatch("[ACGT]+", nucs):
        raise ValueError(f"not a motif of A, C, G and T: {arg!r}")
    reverse = reverse_complement_text(nucs)
    return Motif(name or nucs, nucs, None if reverse == nucs else reverse)


def motif_frame(spark: SparkSession, motifs: list[str | Motif]) -> DataFrame:
    """motifs(motif_ordinal, name, forward, reverse): the argument list as a small table."""
    parsed = [m if isinstance(m, Motif) else parse_motif(m) for m in motifs]
    rows = [(k, m.name, m.forward, m.reverse) for k, m in enumerate(parsed)]
    return spark.createDataFrame(rows, "motif_ordinal int, name string, forward string, reverse string")


def parse_int(text: str) -> int:
    """An integer, decimal or hexadecimal (0x...), commas allowed."""
    t = text.strip().replace(",", "")
    return int(t, 16) if t.lower().startswith("0x") else int(t)


def parse_unitized(text: str, thousands: int = 1000) -> int:
    """An integer with an optional unit K, M or G (of 1000 or 1024); fractions are rounded up."""
    m = re.fullmatch(r"\s*([0-9.,]+)\s*([KMG]?)B?\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not an integer with unit: {text!r}")
    return math.ceil(float(m[1].replace(",", "")) * thousands ** " KMG".index(m[2].upper() or " "))


def parse_probability(text: str, strict: bool = True) -> float:
    """A decimal, percentage or fraction; strict: between 0 and 1."""
    t = text.strip()
    if t.endswith("%"):
        value = float(t[:-1]) / 100
    elif "/" in t:
        top, bottom = t.split("/")
        value = float(top) / float(bottom)
    else:
        value = float(t)
    if strict and not 0 <= value <= 1:
        raise ValueError(f"not a probability: {text!r}")
    return value


def parse_noise_rate(text: str) -> float:
    """A rate like a probability, but not bounded by 1."""
    return parse_probability(text, strict=False)


def commatized(n: int | float | str) -> str:
    """Thousands separators in the integer part of a number or its text."""
    sign, whole, rest = re.fullmatch(r"([-+]?)(\d+)(.*)", str(n)).groups()
    return f"{sign}{int(whole):,}{rest}"
