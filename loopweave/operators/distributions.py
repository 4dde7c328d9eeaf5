"""Length distributions: counting, binning, intersecting, specifying and sampling to a specification."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import formula
from .intervals import by_interval


def length_distribution(df: DataFrame, length: str = "length") -> DataFrame:
    """(length, n) of the rows, ascending."""
    return df.groupBy(length).agg(F.count("*").alias("n")).orderBy(length)


def sum_distributions(parts: list[DataFrame]) -> DataFrame:
    """(length, n): counts of several distributions added by length."""
    return reduce(DataFrame.unionByName, parts).groupBy("length").agg(F.sum("n").cast("long").alias("n")).orderBy("length")


def totals(distribution: DataFrame) -> DataFrame:
    """One row: sequences, bases and the rounded mean length."""
    t = distribution.agg(F.sum("n").cast("long").alias("sequences"), F.sum(F.col("n") * F.col("length")).cast("long").alias("bases"))
    return t.withColumn("mean", F.floor(F.col("bases") / F.col("sequences") + 0.5).cast("long"))


def bin_positions(counts: DataFrame, to_bin: str, from_bin: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(bin, lo, hi, n): counts (pos, n) summed over bins floor(to_bin), with the closed interval of positions of each.

    to_bin is a formula over pos and from_bin, its inverse, one over bin. lo is the ceiling of the inverse at the bin, hi
    the floor at the next one, less one where that belongs to the next bin. An inverse that misses the least position
    by over 1e-6 is an error. Positions outside low and high are left out, and bounds are clamped to them.
    """
    kept = counts
    if low is not None:
        kept = kept.filter(F.col("pos") >= low)
    if high is not None:
        kept = kept.filter(F.col("pos") <= high)
    inverse = lambda x: formula(from_bin, {"bin": x}).cast("double")
    binned_at = lambda x: F.floor(formula(to_bin, {"pos": x}))
    first = kept.agg(F.min("pos").alias("pos"))
    wrong = F.abs(inverse(formula(to_bin, {"pos": F.col("pos")})) - F.col("pos")) > 1e-6
    first = first.select(F.when(wrong, F.raise_error(F.lit("from_bin is not the inverse of to_bin"))).otherwise(F.lit(True)).alias("checked"))
    binned = kept.withColumn("bin", binned_at(F.col("pos"))).groupBy("bin").agg(F.sum("n").cast("long").alias("n"))
    out = binned.withColumn("lo", F.ceil(inverse(F.col("bin"))).cast("long")).withColumn("up", F.floor(inverse(F.col("bin") + 1)).cast("long"))
    out = out.withColumn("hi", F.when(binned_at(F.col("up")) > F.col("bin"), F.col("up") - 1).otherwise(F.col("up")))
    if low is not None:
        out = out.withColumn("lo", F.greatest("lo", F.lit(low).cast("long")))
    if high is not None:
        out = out.withColumn("hi", F.least("hi", F.lit(high).cast("long")))
    # the check is one row, joined so that it runs with the result
    return out.crossJoin(F.broadcast(first)).filter("checked").select("bin", "lo", "hi", "n")


def common_distribution(parts: list[DataFrame], scale: float | None = None) -> DataFrame:
    """(lo, hi, n): the least count of each interval that is in all distributions (lo, hi, n), scaled and rounded up; zeros go."""
    every = reduce(DataFrame.unionByName, parts).groupBy("lo", "hi").agg(F.min("n").alias("n"), F.count("*").alias("_in"))
    out = every.filter(F.col("_in") == len(parts)).drop("_in")
    if scale is not None:
        out = out.withColumn("n", F.ceil(F.col("n") * F.lit(scale)))
    return out.withColumn("n", F.col("n").cast("long")).filter("n > 0").orderBy("lo", "hi")


def distribution_spec(target: DataFrame, distribution: DataFrame) -> DataFrame:
    """(lo, hi, out_count, in_count): how many of what there is are wanted; wanting more than that is an error."""
    joined = target.select("lo", "hi", F.col("n").alias("out_count")).filter("out_count > 0").join(distribution.select("lo", "hi", F.col("n").alias("in_count")), ["lo", "hi"])
    checked = F.when(F.col("out_count") > F.col("in_count"), F.raise_error(F.lit("more wanted than there are")).cast("long")).otherwise(F.col("out_count"))
    return joined.withColumn("out_count", checked).select("lo", "hi", "out_count", "in_count")


def spec_violations(spec: DataFrame) -> DataFrame:
    """Rows of a specification that want more than there are."""
    return spec.filter("out_count > in_count")


def spread_counts(spec: DataFrame, components: DataFrame) -> DataFrame:
    """(component, lo, hi, in_count): what each component has of each interval, 0 where it has none.

    components (component, lo, hi, n) must add up to the specification's in_count; else it is an error.
    """
    names = components.select("component").distinct()
    every = spec.select("lo", "hi", F.col("in_count").alias("_want")).crossJoin(names)
    filled = every.join(components, ["component", "lo", "hi"], "left").withColumn("in_count", F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    total = F.sum("in_count").over(Window.partitionBy("lo", "hi"))
    checked = F.when(total != F.col("_want"), F.raise_error(F.lit("components don't add up")).cast("long")).otherwise(F.col("in_count"))
    return filled.withColumn("in_count", checked).select("component", "lo", "hi", "in_count")


def spread_quota(spec: DataFrame, components: DataFrame, seed: int = 0) -> DataFrame:
    """(component, lo, hi, out_count, in_count): each interval's quota drawn from its members, without replacement.

    How many of each component are drawn is multivariate hypergeometric; an interval's draw is one step, however many
    members it has, and depends on seed, interval and counts alone.
    """
    counts = spread_counts(spec, components)
    wanted = spec.select("lo", "hi", F.col("out_count").alias("_want"))
    grouped = counts.groupBy("lo", "hi").agg(F.array_sort(F.collect_list(F.struct("component", "in_count"))).alias("all")).join(wanted, ["lo", "hi"])

    def draw(lo: pa.Array, hi: pa.Array, there: pa.Array, want: pa.Array) -> pa.Array:
        out = []
        for a, b, n, k in zip(lo.to_pylist(), hi.to_pylist(), there.to_pylist(), want.to_pylist(), strict=True):
            rng = np.random.default_rng([seed, int(a) & 0xFFFFFFFF, int(b) & 0xFFFFFFFF])
            out.append(_drawn(rng, np.array(n, np.int64), int(k)).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    taken = F.arrow_udf(draw, "array<bigint>")("lo", "hi", F.transform("all", lambda x: x["in_count"]), "_want")
    rows = grouped.select("lo", "hi", F.inline(F.transform(F.arrays_zip("all", taken.alias("n")), lambda x: F.struct(x["all"]["component"].alias("component"), x["n"].alias("out_count"), x["all"]["in_count"].alias("in_count")))))
    return rows.select("component", "lo", "hi", "out_count", "in_count")


def _drawn(rng: np.random.Generator, there: np.ndarray, want: int) -> np.ndarray:
    """How many of each kind there are among `want` drawn without replacement: one kind after the other."""
    out, left = np.zeros(len(there), np.int64), int(there.sum())
    for k, n in enumerate(there.tolist()):
        left -= n
        out[k] = rng.hypergeometric(n, left, want) if n and want else 0
        want -= int(out[k])
    return out


def quota_sample(df: DataFrame, spec: DataFrame, key: list[str], length: str = "length", seed: int = 0) -> DataFrame:
    """Rows of df drawn without replacement so that each interval of spec has its out_count.

    A row's rank in its interval is that of a hash of its key, so the sample does not depend on order or partitions.
    Ranks are cut in two levels: the quota lies within the smallest hashes, found from a histogram of the hash's
    leading bits, so only rows of the bin that holds the limit are sorted.
    """
    held = spec.select("lo", "hi", "out_count")
    rows = by_interval(df, held, F.col(length)).withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_b", F.shiftright("_h", 52))
    bins = rows.groupBy("lo", "hi", "_b").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("lo", "hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("_b").alias("_bin"), ahead.alias("_ahead"))
    placed = rows.join(bins, (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi")) & (F.col("_b") == F.col("_bin"))).filter("_ahead < out_count")
    inside = F.row_number().over(Window.partitionBy("lo", "hi", "_b").orderBy("_h", *key))
    return placed.filter(F.col("_ahead") < F.col("out_count")).withColumn("_r", inside).filter("_ahead + _r <= out_count").select(*df.columns, "lo", "hi")


def quota_remainders(spec: DataFrame, sample: DataFrame, df: DataFrame, length: str = "length") -> DataFrame:
    """The specification that is left after a sample (with lo, hi) from rows df: what is still wanted of what is still to come.

    More rows in an interval than the specification expects is an error.
    """
    got = sample.groupBy("lo", "hi").agg(F.count("*").alias("_got"))
    seen = by_interval(df.select(length), spec.select("lo", "hi"), F.col(length)).groupBy("lo", "hi").agg(F.count("*").alias("_seen"))
    out = spec.join(got, ["lo", "hi"], "left").join(seen, ["lo", "hi"], "left")
    left = F.col("in_count") - F.coalesce("_seen", F.lit(0))
    checked = F.when(left < 0, F.raise_error(F.lit("more rows than the specification expects")).cast("long")).otherwise(left)
    return out.select("lo", "hi", (F.col("out_count") - F.coalesce("_got", F.lit(0))).alias("out_count"), checked.alias("in_count"))
