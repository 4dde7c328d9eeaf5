"""Operator 12: whitening of embeddings by a distributed singular value decomposition.

1. Entries become integers, floor(SCALE * c); the fit list holds each distinct integer vector once. Equal vectors are
   collapsed before the shuffle, so a very common vector is one row of each task.
2. Sums by dimension are exact decimals. The rows less their mean form a RowMatrix, whose computeSVD adds up the Gramian
   in the executors; singular values s give the eigenvalues s**2 / n of the covariance. All of them are asked for, as
   MLlib then decomposes the Gramian by LAPACK to double precision instead of iterating.
3. The total variance does not come from the decomposition but from the exact deviations of the fit list: a row's is
   sum((n * x - S)**2), and their sum over n**3 is the trace.
4. Every row is projected where it stands by the means and the leading components, a few vectors, that go with the task.

Defined results
* a null vector or one with null or non-finite entries gives no rows; a vector of length 0 has no components and gives none;
* vectors of different dimension are whitened apart, each dimension by its own fit list (one pass for each);
* components without variance (singular value below RANK of the largest) are left out, so fewer than asked for may come;
* a deviation beyond the range of long, and what rests on it, is null; an entry beyond it counts as the largest long;
* ties (equal eigenvalues) go in LAPACK's order; repeated rows, also of one vec_id, count once in the fit list and have
  their rows each; a null vec_id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SCALE = 256
COMPONENTS = 4
#: Singular values below this part of the largest are taken for zero: the Gramian knows no smaller ones.
RANK = 1e-7

RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
_WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Whitening:
    """The fit of one dimension: rows, sums, eigenvalues and leading eigenvectors (columns), and the total variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    total: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviation(self, x: Column) -> Column:
        """Sum over dimensions of (n * x - S)**2 as a decimal; null beyond 38 digits."""
        sums = F.split(F.lit(",".join(map(str, self.sums))), ",").cast(f"array<{_WIDE}>")
        apart = F.zip_with(x, sums, lambda a, s: F.try_subtract(F.try_multiply(a.cast(_WIDE), F.lit(str(self.n)).cast(_WIDE)), s))
        return F.aggregate(apart, F.lit(0).cast(_WIDE), lambda acc, d: F.try_add(acc, F.try_multiply(d, d)).cast(_WIDE))

    def whitened(self, x: Column) -> Column:
        """The vector less the mean on each component, in units of its deviation: array of double."""
        mean, basis = self.mean, self.vectors / np.sqrt(self.values)

        def run(vectors: pa.Array) -> pa.Array:
            rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, len(mean)))
            out = (rows - mean) @ basis
            ends = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return F.arrow_udf(run, "array<double>")(x)


def integers(embedding: Column) -> Column:
    """floor(SCALE * c) of each entry; null for vectors with null or non-finite entries."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(embedding.isNotNull() & ~bad, F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE)))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of each dimension of distinct integer vectors x; what reaches the driver is a model's size."""
    counted = {r.width: r.n for r in distinct.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).collect() if r.width > 0}
    entries = distinct.select(F.size("x").alias("width"), F.posexplode("x").alias("pos", "v"))
    sums: dict[int, dict[int, int]] = {}
    for r in entries.groupBy("width", "pos").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s")).collect():
        sums.setdefault(r.width, {})[r.pos] = int(r.s)
    out = {}
    for width, n in sorted(counted.items()):
        own = distinct.filter(F.size("x") == width)
        bare = Whitening(n, tuple(sums[width][k] for k in range(width)), np.zeros(0), np.zeros((width, 0)), None)
        mean = F.array(*[F.lit(float(m)) for m in bare.mean]) if width <= 64 else F.split(F.lit(",".join(map(repr, bare.mean.tolist()))), ",").cast("array<double>")
        centred = own.select(array_to_vector(F.zip_with("x", mean, lambda a, m: a.cast("double") - m)).alias("row"))
        found = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row"), n, width).computeSVD(width, False, RANK)
        values, vectors = found.s.toArray() ** 2 / n, found.V.toArray()
        k = int((values[:components] > 0).sum())
        deviations = own.agg(F.try_sum(bare.deviation(F.col("x"))).alias("d")).first().d
        total = None if deviations is None else int(deviations) / n**3
        out[width] = Whitening(n, bare.sums, values[:k], vectors[:, :k], total)
    return out


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance (centred, divisor n) less the identity."""
    k = len(model.values)
    if not k:
        return None
    rows = distinct.filter(F.size("x") == len(model.sums)).select(model.whitened(F.col("x")).alias("w"))
    rows = rows.select(*[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    covariance = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(covariance[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, RESULT) of each usable vector (vec_id, embedding) and component."""
    rows = df.select("vec_id", integers(F.col("embedding")).alias("x")).filter("size(x) > 0")
    distinct = settle(rows.select("x").distinct())
    kind = df.schema["vec_id"].dataType.simpleString()
    out = df.sparkSession.createDataFrame([], f"vec_id {kind}, {RESULT}")
    for width, model in fit(distinct, components).items():
        error = identity_error(distinct, model)
        explained = [float(e / model.total) if model.total else None for e in model.values]
        own = rows.filter(F.size("x") == width)
        placed = own.select("vec_id", model.deviation(F.col("x")).alias("d"), F.posexplode(model.whitened(F.col("x"))).alias("pos", "whitened"))
        part = placed.select(
            "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("d").try_cast("bigint").alias("deviation"), "whitened",
            F.get(F.array(*[F.lit(e).cast("double") for e in explained]), F.col("pos")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
        )
        out = out.unionByName(part)
    return out


def op12_whitening(vectors: DataFrame) -> DataFrame:
    """The contract's result: a row for each vector and component."""
    return whiten(vectors)
