"""Event matrices, rates, uniformity tests, summaries and sorts of alignments; samples of rows by ordinal."""

from __future__ import annotations

import functools
import math
import numbers
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dna
from .durable import cut, few

EVENTS = ("m", "mm", "io", "ix", "do", "dx")


def event_matrix(df: DataFrame) -> DataFrame:
    """df (seq_text, motif_text, ...) without its texts, with the counts of EVENTS and m_ratio."""
    counted = df.withColumn("_e", dna.event_counts(dna.column_kinds(F.col("seq_text"), F.col("motif_text")))).drop("seq_text", "motif_text")
    total = sum((F.col(f"_e.{e}") for e in EVENTS), F.lit(0))
    return counted.select("*", *[F.col(f"_e.{e}").alias(e) for e in EVENTS], F.try_divide(F.col("_e.m"), total).alias("m_ratio")).drop("_e")


def event_totals(matrix: DataFrame) -> DataFrame:
    """One row: sums of the events and their match ratio."""
    sums = matrix.agg(*[F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(e) for e in EVENTS])
    return sums.withColumn("m_ratio", F.try_divide(F.col("m"), sum((F.col(e) for e in EVENTS), F.lit(0))))


def event_rates(matrix: DataFrame) -> DataFrame:
    """One row: each event's share of all, and the summed rates mm, i and d. No events at all is an error."""
    t = event_totals(matrix)
    total = sum((F.col(e) for e in EVENTS), F.lit(0))
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("no events")).cast("long"))
    share = lambda *c: sum((F.col(x) for x in c), F.lit(0)) / checked
    return t.select(*[share(e).alias(f"{e}_rate") for e in EVENTS], share("io", "ix").alias("i_rate"), share("do", "dx").alias("d_rate"))


def truth_rates(catalog: DataFrame) -> DataFrame:
    """Rates of match, mismatch, insertion and deletion over a catalog's rows (m, mm, i, d); null counts are left out."""
    t = catalog.agg(*[F.sum(c).alias(c) for c in ("m", "mm", "i", "d")])
    total = F.col("m") + F.col("mm") + F.col("i") + F.col("d")
    return t.select(*[F.try_divide(F.col(c), total).alias(f"{c}_rate") for c in ("m", "mm", "i", "d")])


def summary(alignments: DataFrame) -> DataFrame:
    """The columns of a summary: line, motif, seq, start, end, strand, seq_len, query_bp, m_ratio, m, mm, i, d.

    line is the block's first line in a file in the order of `line_order`, with three lines and a blank for each block.
    """
    ratio = F.col("m") / (F.col("m") + F.col("mm") + F.col("i") + F.col("d"))
    return alignments.select(
        *(["line"] if "line" in alignments.columns else []), "motif", F.col("name").alias("seq"), "start", "end", "strand", "seq_len", F.col("motif_bases").alias("query_bp"),
        dna.percent_text(ratio).alias("m_ratio"), "m", "mm", "i", "d",
    )


def numbered(df: DataFrame, order: list, block_lines: Column | None = None) -> DataFrame:
    """df with `line`: the first line of each block when blocks are written in order, a blank line between them.

    Lines are sums over all rows before: ranges of the order are numbered on their own and then shifted, so no single
    task holds all rows. The sorted rows are settled first, so that both see the same ranges.
    """
    lines = (block_lines if block_lines is not None else F.lit(3)) + 1
    dealt = cut(df.withColumn("_lines", lines.cast("long")).orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sums = dealt.groupBy("_part").agg(F.sum("_lines").alias("_s"))
    ahead = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("_part").alias("_p"), ahead.alias("_ahead"))
    inside = F.coalesce(F.sum("_lines").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_inside", inside).join(sums, F.col("_part") == F.col("_p")).withColumn("line", 1 + F.col("_ahead") + F.col("_inside")).drop("_lines", "_part", "_at", "_p", "_ahead", "_inside")


def summary_filter(summaries: DataFrame, min_ratio: float) -> DataFrame:
    """Summary rows with at least a match ratio, as their rounded text says."""
    return summaries.filter(dna.percent_value(F.col("m_ratio")) >= F.lit(min_ratio))


def bed(summaries: DataFrame, exact: bool = False) -> DataFrame:
    """BED rows (seq, start, end, name, score, strand); the score is 1000 times the ratio, cut to an integer.

    The cut is of the floating-point product, so that some ratios come out one too low; exact rounds instead.
    """
    value = F.regexp_replace("m_ratio", "%$", "").cast("double") / F.lit(100.0)
    score = F.round(value * 1000) if exact else F.floor(value * 1000)
    return summaries.select("seq", "start", "end", F.lit(".").alias("name"), score.cast("int").alias("score"), "strand")


#: Sort keys of alignments: columns, and whether they descend by default.
SORTS = {
    "mratio": (["match_ratio"], True), "score": (["score"], True), "match": (["m"], True), "length": (["motif_bases"], True),
    "name": (["name", "start", "end"], False), "position": (["start", "end"], False),
}


def sort_alignments(alignments: DataFrame, key: str = "mratio-", ties: tuple[str, ...] = ("seq_ordinal", "motif_ordinal", "emit_ordinal")) -> DataFrame:
    """Alignments by mratio, score, match, length, name or position; a - or + at the end of the key sets the direction.

    Match ratios are compared as printed, in tenths of a percent; names in natural order. Ties keep the order of emission.
    """
    name = key.rstrip("+-")
    columns, descends = SORTS[name]
    descends = key.endswith("-") if key[-1] in "+-" else descends
    terms = []
    for c in columns:
        e = F.col(c)
        if c == "match_ratio":
            e = dna.percent_text(F.col("m") / (F.col("m") + F.col("mm") + F.col("i") + F.col("d")))
            e = dna.percent_value(e)
        elif c == "name":
            e = dna.natural_key(e)
        terms.append(e.desc() if descends else e.asc())
    return alignments.orderBy(*terms, *[t for t in ties if t in alignments.columns])


def subsample(df: DataFrame, ordinal: str, k: int, n: int) -> DataFrame:
    """The k-th of every n rows by ordinals from 1."""
    return df.filter(F.pmod(F.col(ordinal) - 1, F.lit(n)) == k - 1)


def head(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """Rows of the first n ordinals, from 1."""
    return df.filter(F.col(ordinal) <= n)


def error_positions(df: DataFrame) -> DataFrame:
    """df without its texts, with the relative positions of its error columns."""
    mask = dna.match_mask(F.col("seq_text"), F.col("motif_text"))
    return df.withColumn("positions", dna.error_positions(mask)).drop("seq_text", "motif_text")


def _trial_bounds(rng: np.random.Generator, counts: np.ndarray, events: int, trials: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Least and largest counts of trials, in growing blocks; the draws are those of one trial after the other."""
    block = 16
    while trials > 0:
        n = min(block, trials)
        drawn = rng.multivariate_hypergeometric(counts, events, size=n) if events else np.zeros((n, len(counts)), np.int64)
        yield drawn.min(axis=1), drawn.max(axis=1)
        trials -= n
        block = min(4 * block, 1 << 12)


#: Tasks for each core that test alignments.
SPREAD = 4


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows in a fixed number of parts: they are few bytes and much work each, so parts made by size would be too few.

    The parts follow a hash of the keys, as Spark leaves out an exchange by the same columns as the one before.
    """
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * SPREAD, F.xxhash64(*keys))


def uniformity_minmax(matrix: DataFrame, keys: list[str], n_positions: int, which: str = "x", trials: int = 10_000, needed: int = 1, seed: int = 0) -> DataFrame:
    """(keys, outcome, trials_run): whether errors (x) or matches (m) spread over motif positions as chance would.

    matrix has m0.., x0.. for each alignment. A trial draws as many events as there are, without replacement, from the
    alignment's columns; it is passed if the real least count is no less than the trial's and the real largest no
    more. Alignments pass with `needed` such trials. The draws are seeded by the keys, whole numbers or texts, so results
    don't depend on order or partitions.
    """

    def number(key) -> int:
        return int(key) & 0xFFFFFFFF if isinstance(key, numbers.Number) and key == key else zlib.crc32(str(key).encode())

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            r = row._asdict()
            m, x = (np.array([r[f"{c}{k}"] for k in range(n_positions)], np.int64) for c in "mx")
            real, columns = (x if which == "x" else m), m + x
            rng = np.random.default_rng([seed, *[number(r[k]) for k in keys]])
            passed = run = 0
            for low, high in _trial_bounds(rng, columns, int(real.sum()), trials):
                hits = np.flatnonzero((real.min() >= low) & (real.max() <= high))
                if passed + len(hits) >= needed:
                    run += int(hits[needed - passed - 1]) + 1
                    passed = needed
                    break
                passed += len(hits)
                run += len(low)
            out.append([r[k] for k in keys] + [passed >= needed, run])
        return pd.DataFrame(out, columns=[*keys, "uniform", "trials_run"])

    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", uniform boolean, trials_run int"
    return _dealt(matrix, keys).mapInPandas(lambda it: (test(p) for p in it), schema)


def _gamma_q(a: float, x: float) -> float:
    """The upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for k in range(1, 1000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_squared_p(statistic: float, freedom: int) -> float:
    return _gamma_q(freedom / 2, statistic / 2)


def _noncentral_tail(limit: float, freedom: int, shift: float) -> float:
    """P(X > limit) of a non-central chi-squared: a Poisson mixture of central ones."""
    total, weight, k = 0.0, math.exp(-shift / 2), 0
    while k < 1000 and (weight > 1e-17 or k < shift):
        total += weight * _gamma_q(freedom / 2 + k, limit / 2)
        k += 1
        weight *= shift / 2 / k
    return total


@functools.lru_cache(1 << 16)
def alpha_for_power(n: int, freedom: int, effect: float = 0.3, power: float = 0.8) -> float:
    """The significance level at which a test of n events has the power for an effect size; 1e-10 if none is found."""
    shift = n * effect * effect
    low, high = 0.0, freedom + shift + 50 * math.sqrt(2 * (freedom + 2 * shift) + 1)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _noncentral_tail(mid, freedom, shift) > power else (low, mid)
    alpha = chi_squared_p(low, freedom)
    return alpha if 1e-10 < alpha < 1 else 1e-10


def uniformity_chi_squared(matrix: DataFrame, keys: list[str], n_positions: int, which: str = "x", effect: float = 0.3, power: float = 0.8) -> DataFrame:
    """(keys, statistic, p_value, outcome): a chi-squared test that events are the same share of columns everywhere.

    untestable: some position has fewer than 5 matches or errors; rejected: the p value is at most the level that
    the wanted power gives; else uniform. The statistic is SQL; only the tail functions run in Python.
    """
    m, x = ([F.col(f"{c}{k}").cast("double") for k in range(n_positions)] for c in "mx")
    total_m, total_x = sum(m[1:], m[0]), sum(x[1:], x[0])
    n = total_m + total_x
    terms = []
    for a, b in zip(m, x, strict=True):
        for seen, share in ((a, total_m), (b, total_x)):
            expected = (a + b) * share / n
            terms.append(F.try_divide((seen - expected) * (seen - expected), expected))
    base = matrix.select(
        *keys, F.least(*m, *x).alias("least"), F.coalesce(sum(terms[1:], terms[0]), F.lit(0.0)).alias("statistic"), (total_x if which == "x" else total_m).alias("n_events")
    )

    freedom = n_positions - 1

    def levels(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(_level=[alpha_for_power(int(e), freedom, effect, power) for e in pdf["_e"]])

    def tails(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            p = [chi_squared_p(s, freedom) for s in pdf["statistic"]]
            outcome = ["untestable" if low < 5 else "rejected" if q <= a else "uniform" for low, q, a in zip(pdf["least"], p, pdf["_level"], strict=True)]
            yield pdf[[*keys, "statistic"]].assign(p_value=p, outcome=outcome)

    # a level takes long and depends on the number of events alone: each number's is worked out once
    base = cut(base)
    numbers_ = base.select(F.col("n_events").cast("bigint").alias("_e")).distinct()
    level = few(_dealt(numbers_, ["_e"]).mapInPandas(levels, "_e bigint, _level double"))
    known = base.join(level, F.col("n_events").cast("bigint") == F.col("_e"))
    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", statistic double, p_value double, outcome string"
    return _dealt(known, keys).mapInPandas(tails, schema)


def uniformity_filter(alignments: DataFrame, outcomes: DataFrame, keys: list[str], discard: str = "bad") -> DataFrame:
    """Alignments less those whose test failed (bad), less those that passed (good), or all with the outcome (none)."""
    joined = alignments.join(outcomes.select(*keys, "uniform"), keys, "left")
    return {"bad": joined.filter("uniform"), "good": joined.filter("not uniform"), "none": joined}[discard]
