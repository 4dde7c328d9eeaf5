"""Reader of tandem-repeat reports in html: one sequence to a file, a section for each repeat, alignments in triplets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import reverse_complement_text

SCHEMA = (
    "file string, line_number bigint, name string, seq_len int, start int, `end` int, score int, period int, copies double, "
    "consensus_size int, motif string, strand string, seq_text string, motif_text string, error_text string"
)
_SECTION = re.compile(r"^Found at ", re.M)
_INDICES = re.compile(r"^\s*Indices: +(\d+)--(\d+) +Score: +(\d+)\s*$", re.M)
_PERIOD = re.compile(r"^\s*Period size: +(\d+) +Copynumber: +([\d.]+) +Consensus size: +(\d+)\s*$", re.M)
_NUMBERED = re.compile(r"^ *\d+ \S")
#: Fixed value: columns before the text of a triplet's lines.
INDENT = 12


def canonical(nucs: str) -> tuple[str, str]:
    """The smallest rotation of a motif or its reverse complement, and the strand it is on."""
    turns = [(m[k:] + m[:k], s) for m, s in ((nucs, "+"), (reverse_complement_text(nucs), "-")) for k in range(len(nucs))]
    return min(turns)


def parse(text: str, file: str = "") -> Iterator[tuple]:
    """Repeats of one report as tuples in the order of SCHEMA."""
    head = re.search(r"^Sequence: +(\S+)(?: +length=(\d+))?\s*$", text, re.M)
    if not head:
        return
    starts = [m.start() for m in _SECTION.finditer(text)]
    for at, end in zip(starts, [*starts[1:], len(text)], strict=True):
        section = text[at:end]
        line = text.count("\n", 0, at) + 1
        indices, period = _INDICES.search(section), _PERIOD.search(section)
        stop = re.search(r"^Statistics", section, re.M)
        pattern = re.search(r"^Consensus pattern .*\n", section, re.M)
        if not (indices and period and stop and pattern):
            raise ValueError(f"{file}: section at line {line} is truncated")
        seq, motif = _texts(section[period.end() : stop.start()], file, line)
        size, nucs = int(period[3]), ""
        for row in section[pattern.end() :].split("\n"):
            if len(nucs) >= size:
                break
            nucs += row.strip()
        if len(nucs) != size:
            raise ValueError(f"{file}: consensus at line {line} is not {size} bases long")
        errors = "".join("x" if "-" in (s, q) else "=" if s == q else "*" for s, q in zip(seq, motif, strict=True))
        yield (
            file, line, head[1], int(head[2]) if head[2] else None, int(indices[1]) - 1, int(indices[2]), int(indices[3]), int(period[1]), float(period[2]),
            size, *canonical(nucs), seq, motif, errors,
        )


def _texts(body: str, file: str, line: int) -> tuple[str, str]:
    """Sequence and motif text of the triplets: pairs of numbered lines one after the other, spaces between copies dropped.

    The flanks before and after the alignment are numbered lines on their own.
    """
    rows = body.split("\n")
    seq, motif = [], []
    k = 0
    while k + 1 < len(rows):
        if _NUMBERED.match(rows[k]) and _NUMBERED.match(rows[k + 1]):
            s, q = rows[k].rstrip()[INDENT:], rows[k + 1].rstrip()[INDENT:]
            if len(s) != len(q):
                raise ValueError(f"{file}: texts of different lengths in section at line {line}")
            pairs = [(a, b) for a, b in zip(s, q, strict=True) if a != " "]
            seq += [a for a, _ in pairs]
            motif += [b for _, b in pairs]
            k += 2
        else:
            k += 1
    return "".join(seq), "".join(motif)


def read_trf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Repeats (SCHEMA) of reports; starts are 0-based, motifs canonical."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    names = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for file, text in zip(pdf["file"], pdf["value"], strict=True):
                yield pd.DataFrame(list(parse(text, file)), columns=names)

    return files.mapInPandas(run, SCHEMA)
