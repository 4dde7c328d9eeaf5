"""Words of k bases of sequences, counted for each key: what follows from the counts is made by table, in Arrow batches.

Only sequences move, dealt by their key; the many rows that follow from one sequence are made and added up where it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASES = "ACGT"
#: Rows of a batch that is handed back, about.
ROWS = 1 << 16
_CODES = np.full(256, 4, np.uint8)
_CODES[np.frombuffer(BASES.encode(), np.uint8)] = range(4)


def spelled(k: int) -> list[str]:
    """All words of k bases, in order of their codes."""
    return ["".join(w) for w in product(BASES, repeat=k)]


def codes(seq: str, k: int) -> np.ndarray:
    """The codes of the words of k bases of a sequence, from left to right."""
    found = _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if (found > 3).any():
        raise ValueError("a sequence with other characters than A, C, G and T")
    n = max(len(found) - k + 1, 0)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out = out * 4 + found[j : j + n]
    return out


def per_key(df: DataFrame, key: str, seq: str, k: int, rows: Callable[[np.ndarray], list[pa.Array]], columns: str) -> DataFrame:
    """(key, columns): rows(counts) of each key, where counts has the number of each word of k bases in the key's sequences.

    A key that occurs in many rows is added up as its rows pass by; a worker holds one table of counts.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size, last, counts = 0, None, None
        kind, names = pa.int64(), []

        def finish() -> pa.RecordBatch:
            keys = pa.array([x for x, _ in made], kind).take(pa.array(np.repeat(np.arange(len(made)), [len(c[0]) for _, c in made])))
            return pa.RecordBatch.from_arrays([keys, *(pa.concat_arrays(c) for c in zip(*(c for _, c in made), strict=True))], names=names)

        names = [key, *(c.split()[0] for c in columns.split(", "))]
        for batch in batches:
            kind = batch.column(0).type
            for of, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if counts is not None and of != last:
                    made.append((last, rows(counts)))
                    size += len(made[-1][1][0])
                    counts = None
                    if size >= ROWS:
                        yield finish()
                        made, size = [], 0
                if counts is None:
                    last, counts = of, np.zeros(4**k, np.int64)
                counts += np.bincount(codes(text or "", k), minlength=4**k)
        if counts is not None:
            made.append((last, rows(counts)))
        if made:
            yield finish()

    return df.select(key, seq).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def neighbor_counts(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, neighbor, n): how often each text is at one substitution, insertion or deletion from a word of the key's sequences.

    Every way from a place to a neighbour counts, as in `dna.motif_neighbors`.
    """
    texts = [w for n in (k - 1, k, k + 1) for w in spelled(n)]
    number = {w: at for at, w in enumerate(texts)}

    def beside(w: str) -> list[str]:
        put = [w[:i] + b + w[i:] for i in range(k + 1) for b in BASES]
        return [w[:i] + b + w[i + 1 :] for i in range(k) for b in BASES if b != w[i]] + put + [w[:i] + w[i + 1 :] for i in range(k)]

    table = np.array([[number[x] for x in beside(w)] for w in spelled(k)], np.int32)
    shown = pa.array(texts)

    def rows(counts: np.ndarray) -> list[pa.Array]:
        own = np.flatnonzero(counts)
        total = np.bincount(table[own].ravel(), np.repeat(counts[own], table.shape[1]).astype(np.float64))  # exact below 2**53
        found = np.flatnonzero(total)
        return [shown.take(pa.array(found)), pa.array(total[found].astype(np.int64))]

    return per_key(df, key, seq, k, rows, "neighbor string, n bigint")


def canonical_words(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, motif, canonical, strand): the distinct words of k bases of the key's sequences, with what `dna.canonical_motif` gives."""
    texts = spelled(k)
    turn = str.maketrans("ACGT", "TGCA")
    round_ = lambda w, side: [(w[i:] + w[:i], side) for i in range(k)]
    best = [min(round_(w, "+") + round_(w[::-1].translate(turn), "-")) for w in texts]
    shown = [pa.array(texts), pa.array([b[0] for b in best]), pa.array([b[1] for b in best])]

    def rows(counts: np.ndarray) -> list[pa.Array]:
        found = pa.array(np.flatnonzero(counts))
        return [c.take(found) for c in shown]

    return per_key(df, key, seq, k, rows, "motif string, canonical string, strand string")
