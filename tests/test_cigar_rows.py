"""Cigars, tags and lifts by batches, and how work on few bytes is dealt."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loopweave.functions import cigars as S
from loopweave.operators import events as E
from loopweave.operators import intervals as I


def test_lift_follows_a_walk_of_the_cigar():
    rnd = random.Random(2)
    rows = []
    for _ in range(400):
        ops = [(rnd.randint(1, 12), rnd.choice("MID")) for _ in range(rnd.randint(0, 7))]
        low = rnd.randint(95, 160)
        rows.append((rnd.choice(["", " "]).join(f"{n}{o}" for n, o in ops), 100, low, low + rnd.randint(0, 40), ops))
    rows.append((None, 100, 100, 110, []))

    def walk(ops, position):
        g, r, found = 100, 0, 0
        for n, o in ops:
            if o != "D" and g < position:
                found = r + (min(n, position - g) if o == "M" else n)
            g, r = g + (o != "I") * n, r + (o != "D") * n
        return found

    got = S._lifted(*(pa.array(c) for c in list(zip(*rows))[:4])).to_pylist()
    for (text, _, low, high, ops), x in zip(rows, got, strict=True):
        want = (walk(ops, low), walk(ops, high), sum(n for n, o in ops if o != "D")) if text is not None else (None,) * 3
        assert (x["low"], x["high"], x["r_len"]) == want
    with pytest.raises(ValueError):
        S.operations(pa.array(["3000000000M"]), b"MID")


def test_sam_events_of_odd_rows():
    cigar = [" 3M2I4M 1D5M", "10=2X", None, "", "4M", "007M", "5S3M", "3M2D1M"]
    md = ["7A0^C5", "3A0^AC2N6", "4", "", None, "6T", "3", "3^AC^G1"]
    got = S._sam(pa.array(cigar, pa.string()), pa.array(md, pa.string())).to_pylist()
    for c, t, x in zip(cigar, md, got, strict=True):
        ops = [(int(n), o) for n, o in re.findall("([0-9]+)([MIDNSHP=X])", re.sub(r"\s+", "", c or ""))]
        bare = re.sub(r"\^[A-Z]+", "|", t or "")
        m, mm, deleted = sum(map(int, re.findall("[0-9]+", bare))), len(re.findall("[A-Z]", bare)), sum(len(d) - 1 for d in re.findall(r"\^[A-Z]+", t or ""))
        total = lambda k: sum(n for n, o in ops if o in k)
        count = lambda k: sum(o == k for _, o in ops)
        gaps = [count("I"), total("I") - count("I"), count("D"), total("D") - count("D")]
        agree = None if c is None or t is None else m + mm == total("M=X") and deleted == total("D")
        assert list(x.values()) == [*((m, mm) if t is not None else (None, None)), *(gaps if c is not None else [None] * 4), agree]


def test_sequences_that_are_short_take_one_bin(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("seq"), (F.col("id") % 1000).alias("start"), (F.col("id") % 1000 + 500).alias("end"))
    out = I.overlap_join(rows, rows)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 200_000


def test_alignments_are_tested_in_many_tasks(spark):
    matrix = spark.range(400).groupBy("id").agg(*[F.sum(F.col("id") % 7 + 8).alias(f"{c}{k}") for k in range(2) for c in "mx"])
    for test in (E.uniformity_minmax, E.uniformity_chi_squared):
        assert test(matrix, ["id"], 2).select(F.spark_partition_id().alias("p")).distinct().count() > 8
