"""Formulas take a fixed list of names; the filter before the aligner loses no row."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loopweave.functions.config import PRESETS, parse_motif, thresholds
from loopweave.functions.formula import formula
from loopweave.functions.loop_align import search
from loopweave.operators import align as A
from loopweave.operators import distributions as L
from loopweave.operators import events as E


def test_formulas(spark):
    df = spark.createDataFrame([(7.0, 12)], "pos double, bin_pos long")
    at = {"pos": F.col("pos"), "bin_pos": F.col("bin_pos")}
    cases = {
        "pos * 2 + bin_pos": 26.0, "max(pos, bin_pos, 3) - min(pos, 1)": 11.0, "ceil(pos / 2) + floor(-0.5)": 3, "int(-2.7)": -2, "round(2.5)": 3, "pow(2, 5) + 2 ** 3": 40.0,
        "log2(8) + log10(100) + log(exp(1))": 6.0, "sqrt(pos + 2) + sin(0) + abs(-1)": 4.0, "2 < pos <= 7 and not bin_pos == 3": True, "pi > e or pos < 0": True, "7 // 2 + 7 % 4": 6,
    }
    got = df.select(*[formula(t, at).alias(f"c{k}") for k, t in enumerate(cases)]).first()
    assert [pytest.approx(x) for x in got] == [float(x) if isinstance(x, float) else x for x in cases.values()]
    for bad in ("reflect('java.lang.System', 'exit')", "pos.x", "other + 1", "[1]", "'text'", "pos if 1 else 2", "max()", "lambda: 1", "floor(pos", "sum(pos)", "pos; 1", "__import__('os')"):
        with pytest.raises(ValueError):
            formula(bad, at)


def test_names_that_hold_other_names(spark):
    counts = spark.createDataFrame([(k, 1) for k in range(1, 40)], "pos long, n long")
    rows = L.bin_positions(counts, "sqrt(pos)", "pow(bin, 2)").collect()
    assert {(r.bin, r.lo, r.hi, r.n) for r in rows} == {(b, b * b, (b + 1) ** 2 - 1, min(39, (b + 1) ** 2 - 1) - b * b + 1) for b in range(1, 7)}
    with pytest.raises(ValueError):
        L.bin_positions(counts, "pos / 50", "position * 50")


def test_trials_take_names_as_keys(spark):
    df = spark.createDataFrame([("read/1", 5, 4, 1, 2), ("read/2", 9, 1, 0, 8), (None, 5, 5, 1, 1)], "name string, m0 long, m1 long, x0 long, x1 long")
    rows = [sorted(map(str, E.uniformity_minmax(df.repartition(n), ["name"], 2, trials=200).collect())) for n in (1, 3)]
    assert rows[0] == rows[1] and len(rows[0]) == 3


def noisy(rnd, motif, n, error):
    out = []
    for c in (motif * (n // len(motif) + 1))[:n]:
        if rnd.random() < error:
            out.append(rnd.choice(["", rnd.choice("ACGT"), c + rnd.choice("ACGT")]))
        else:
            out.append(c)
    return "".join(out)


def fullest(seq, words, q, width):
    blocks = [seq[k : k + width] for k in range(0, len(seq), width)]
    return max((sum(b[k : k + q] in words for k in range(len(b) - q + 1)) for b in blocks), default=0)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from(["GGAAT", "ACGTTGCA", "AAC", "CTTGGATCCAGT"]), st.sampled_from([0.8, 0.85, 0.92]), st.integers(40, 120), st.floats(0, 0.3))
def test_what_is_reported_passes_the_rule(seed, name, ratio, length, error):
    rnd = random.Random(seed)
    limits, motif = thresholds(length, ratio), parse_motif(name)
    rule = A.gram_rule(motif, limits)
    around = lambda: "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 60)))
    planted = noisy(rnd, rnd.choice([motif.forward, motif.reverse]), rnd.randint(length, 2 * length), error)
    seq = around() + planted + around()
    found = search([seq], [(motif.forward, motif.reverse)], PRESETS["default"], limits)[0]
    if rule and found:
        q, least, width = rule
        assert any(fullest(seq, set(A.motif_words(x, q)), q, width) >= least for x in (motif.forward, motif.reverse))


def test_rows_are_the_same_with_and_without_the_filter(spark):
    rnd = random.Random(4)
    motifs = ["GGAAT", "ACGTTGCA", "TTC"]
    limits = thresholds(60, 0.85)
    rows = []
    for k in range(60):
        around = ["".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 300))) for _ in range(2)]
        planted = noisy(rnd, motifs[k % 3], rnd.randint(50, 200), 0.02 * (k % 12)) if k % 2 else ""
        rows.append((k, f"s{k}", around[0] + planted + around[1]))
    df = spark.createDataFrame([*rows, (60, "none", None), (61, "empty", "")], "seq_ordinal long, name string, nt string")
    for strands in ("both", "forward"):
        a, b = (sorted(map(tuple, A.align_repeats(df, motifs, PRESETS["default"], limits, strands, excised=True, grams=g).collect())) for g in (True, False))
        assert a == b and a
    plain = spark.createDataFrame([(k, "", "".join(rnd.choice("ACGT") for _ in range(4000))) for k in range(40)], "seq_ordinal long, name string, nt string")
    kept = A.likely_motifs(plain, motifs, thresholds(400, 0.85)).agg(F.sum(F.size("likely"))).first()[0]
    assert kept < 0.1 * 3 * 40  # of sequences without repeats few pairs reach the aligner
    assert math.isclose(A.likely_motifs(df, motifs, thresholds(60, None)).agg(F.avg(F.size("likely"))).first()[0], 3)


def test_many_motifs_of_one_sequence_use_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(A, "PART", 20_000)
    rnd = random.Random(8)
    motifs = sorted({"".join(rnd.choice("ACGT") for _ in range(6)) for _ in range(300)})
    df = spark.createDataFrame([(1, "s", noisy(rnd, motifs[5], 200, 0.02) + noisy(rnd, motifs[9], 150, 0.02)), (2, "t", "ACGT" * 20)], "seq_ordinal long, name string, nt string")
    parsed, limits = [parse_motif(m) for m in motifs], thresholds(60, 0.85)
    parts = A.dealt(df.withColumn("likely", F.lit(None).cast("array<int>")), parsed)
    counts = {r.seq_ordinal: (r.n, r.m, r.most) for r in parts.groupBy("seq_ordinal").agg(F.count("*").alias("n"), F.sum(F.size("likely")).alias("m"), F.max(F.size("likely")).alias("most")).collect()}
    assert counts[1][0] >= 30 and counts[1][1] == counts[2][1] == len(motifs) and counts[1][2] * 350 * 6 <= 30_000
    used = parts.repartition(8, F.xxhash64("seq_ordinal", "name", "likely")).select(F.spark_partition_id()).distinct().count()
    assert used == 8
    rows = [sorted(map(tuple, A.align_repeats(df, parsed, PRESETS["default"], limits, partitions=p, grams=g).collect())) for p, g in ((8, False), (8, True), (None, False))]
    assert rows[0] == rows[1] == rows[2] and {r[5] for r in rows[0]} >= {motifs[5], motifs[9]}
