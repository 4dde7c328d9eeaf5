"""Readers and writers: round trips, edge cases and errors."""

import os
import subprocess
import sys
from pathlib import Path

import random

import pytest
from pyspark.sql import functions as F

from loopweave.functions import dna as D
from loopweave.functions.config import PRESETS, thresholds
from loopweave.operators import align as A
from loopweave.operators import consensus as C
from loopweave.operators import distributions as L
from loopweave.operators import events as E
from loopweave.operators import generators as G
from loopweave.operators import intervals as I
from loopweave.operators import reads as R
from loopweave.sources import blocks as B
from loopweave.sources import sinks as K
from loopweave.sources import text as T
from loopweave.sources import trf


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first words\nACGTn\nacgt\n>two\n>three x\nRYAC\n")
    rows = T.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_ordinal").collect()
    assert [(r.name, r.nt) for r in rows] == [("one", "ACGTNACGT"), ("two", ""), ("three", "NNAC")]
    (tmp_path / "b.fa").write_text("ACGT\n>x\nAC")
    assert [(r.name, r.nt) for r in T.read_fasta(spark, str(tmp_path / "b.fa")).orderBy("seq_ordinal").collect()] == [("sequence1", "ACGT"), ("x", "AC")]
    (tmp_path / "c.fa").write_text(">x\nAC T\n")
    with pytest.raises(Exception, match="bad character"):
        T.read_fasta(spark, str(tmp_path / "c.fa")).collect()
    (tmp_path / "d.fa").write_text(">a long  name \nAC\n>\nGT\n")
    assert [r.name for r in T.read_fasta(spark, str(tmp_path / "d.fa"), full_name=True).orderBy("seq_ordinal").collect()] == ["a long  name", "(no_name)"]
    (tmp_path / "e.fa").write_text(">a\nAC>b\n")
    with pytest.raises(Exception, match="bad character"):
        T.read_fasta(spark, str(tmp_path / "e.fa")).collect()
    (tmp_path / "f.fa").write_text(">a\nAC\n>b")
    with pytest.raises(Exception, match="ends in a header"):
        T.read_fasta(spark, str(tmp_path / "f.fa")).collect()
    both = T.both_strands(spark.createDataFrame([("x", "AAC")], "name string, nt string")).collect()
    assert [(r.strand, r.nt) for r in both] == [("+", "AAC"), ("-", "GTT")]


def test_blocks_survive_writing_and_reading(spark, tmp_path):
    nt = "TTTTTTTT" + "GGAAT" * 30 + "GGATT" + "GGAAT" * 30
    seqs = spark.createDataFrame([(0, "s1", nt), (1, "s2", nt[::-1].translate(str.maketrans("ACGT", "TGCA")))], "seq_ordinal long, name string, nt string")
    found = A.align_repeats(seqs, ["GGAAT"], PRESETS["historical"], thresholds(50, 0.8)).cache()
    K.write_blocks(found, str(tmp_path / "out"), ["seq_ordinal", "emit_ordinal"], stats=True)
    files = sorted((tmp_path / "out").glob("part*"))
    assert files[-1].read_text().endswith(K.MARKER + "\n") and sum(K.MARKER in p.read_text() for p in files) == 1
    assert B.read_blocks(spark, str(tmp_path / "out"), whole=True).count() == 2
    (tmp_path / "one.txt").write_text("".join(p.read_text() for p in files))
    both = T.concatenate(spark, [str(tmp_path / "one.txt")] * 2, "# any end-of-file").collect()
    assert both[-1].value == "# any end-of-file" and sum("seq" not in r.value and "end-of-file" in r.value for r in both) == 1
    (tmp_path / "both.txt").write_text("\n".join(r.value for r in both))
    assert B.read_blocks(spark, str(tmp_path / "both.txt")).count() == 4
    (tmp_path / "open.txt").write_text("".join(p.read_text() for p in files).replace(K.MARKER, ""))
    with pytest.raises(Exception, match="marker is missing"):
        T.concatenate(spark, [str(tmp_path / "open.txt")], "# x").collect()
    assert T.concatenate(spark, [str(tmp_path / "open.txt")], "# x end-of-file", tolerant=True).count() > 4
    back = {(r.name, r.start, r.end, r.seq_text, r.motif_text, r.strand, r.m, r.score, r.error_text) for r in B.read_blocks(spark, str(tmp_path / "one.txt")).collect()}
    mask = D.match_mask(F.col("seq_text"), F.col("motif_text"))
    want = {(r.name, r.start, r.end, r.seq_text, r.motif_text, r.strand, r.m, r.score, r.mask) for r in found.withColumn("mask", mask).collect()}
    assert back == want and len(want) == 2
    kept = C.consensus_filter(found, ["seq_ordinal", "emit_ordinal"])
    assert kept.count() == 2
    assert C.sliced_consensus_filter(found, ["seq_ordinal", "emit_ordinal"], 100, 50).count() == 2
    assert A.alignment_crc(found).filter("length(crc) = 8").count() == 2
    assert E.sort_alignments(found, "name+").first().name == "s1"
    turned = K.show_forward(found).filter("start > end")
    assert turned.count() == 1 and C.motif_forward(turned).filter("start < end").count() == 1
    assert C.msa_report(found, ["seq_ordinal"]).count() > 10


def test_positional_lines(spark):
    extra = ["# position 0 [G] mRatio=88.8% m=1 mm=2 i=0 d=0 mmA=0", "# crc 00000000", "# position 1 [A] mRatio=50.0% m=1 mm=1 i=0 d=0 mmA=1"]
    df = spark.createDataFrame([(extra,)], "extra_lines array<string>")
    got = T.positional_stats(df).first().positional
    assert [(p.pos, p.nuc, p.stats["mm"], p.stats["mRatio"]) for p in got] == [(0, "G", 2.0, 88.8), (1, "A", 1.0, 50.0)]
    with pytest.raises(Exception, match="out of order"):
        T.positional_stats(spark.createDataFrame([(extra[2:],)], "extra_lines array<string>")).collect()


def test_columns_of_text(spark):
    rows = T.parse_summary(lines(spark, "line motif seq start end", "1 GGAAT s 5 9 + 100", "# note"))
    assert [(r.motif, r.seq, r.start, r.end) for r in rows.collect()] == [("GGAAT", "s", 5, 9)]
    with pytest.raises(Exception, match="end before start"):
        T.parse_summary(lines(spark, "1 GGAAT s 9 5")).collect()
    c = T.parse_cigars(lines(spark, "r1 chr1- 10 20 5M 2I 5M")).first()
    assert (c.read, c.seq, c.strand, c.cigar) == ("r1", "chr1", "-", "5M2I5M")
    with pytest.raises(Exception, match="bad cigar"):
        T.parse_cigars(lines(spark, "r1 chr1 10 20 5M0I")).collect()
    p = T.parse_paf(lines(spark, "q\t10\t0\t9\t+\tt\t20\t1\t9\t8\t9\t60\tcs:Z::5*ac\tNM:i:1")).first()
    assert p.tags["cs"] == ":5*ac" and p.target_start == 1
    with pytest.raises(Exception, match="bad line"):
        T.parse_paf(lines(spark, "q\t10\t0\t9\t+\tt\t20\t1\t9\t8\t9\t60\tNM:i:1\tNM:i:2")).collect()
    s = T.parse_spec(lines(spark, "375-378 2 5", "400 1 1")).collect()
    assert [(r.lo, r.hi, r.out_count, r.in_count) for r in s] == [(375, 378, 2, 5), (400, 400, 1, 1)]
    with pytest.raises(Exception, match="more wanted"):
        T.parse_spec(lines(spark, "400 2 1")).collect()
    assert T.parse_arrays(lines(spark, "100 GGAAT-")).first().strand == "-"
    assert T.parse_distribution(lines(spark, "5-7 3")).first().n == 3
    iv = T.parse_intervals(lines(spark, "chr1 5 9 a+", "chr1 7 8 b"))
    assert T.same_width(iv).first().ok and iv.first().tags == ["a+"]
    assert [r.x for r in iv.select(D.flip_strand(F.get("tags", 0)).alias("x")).collect()] == ["a-", "b"]


def test_trf_report(spark, tmp_path):
    text = """Sequence: read1 length=50

Found at i:11 original size:5 final size:5

Indices: 11--21  Score: 20
Period size: 5  Copynumber: 2.2  Consensus size: 5

          1 AAAAAAAAAA

                     *
         11 TTCCA TTCGA T
          1 TTCCA TTCCA T

         22 GGGGG

Statistics
Matches: 5,  Mismatches: 1, Indels: 0

Consensus pattern (5 bp):
TTCCA
"""
    (tmp_path / "r.html").write_text(text)
    r = trf.read_trf(spark, str(tmp_path / "r.html")).first()
    assert (r.start, r.end, r.period, r.seq_text, r.motif_text, r.error_text) == (10, 21, 5, "TTCCATTCGAT", "TTCCATTCCAT", "========*==")
    assert (r.motif, r.strand) == ("AATGG", "-")


def test_percent_text_rounds_like_c(spark):
    values = [0.3125, 0.3195, 0.3175, 0.901, 0.9015, 1.0, 0.0, 0.99949, 2 / 3]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(D.percent_text(F.col("v"))).collect()]
    assert got == ["%.1f%%" % (100 * v) for v in values]


def test_bed_cuts_scores(spark):
    s = spark.createDataFrame([("s", 1, 2, "+", "90.1%"), ("s", 1, 2, "+", "89.5%")], "seq string, start int, end int, strand string, m_ratio string")
    assert [r.score for r in E.bed(s).collect()] == [int(1000 * (90.1 / 100)), int(1000 * (89.5 / 100))]
    assert [r.score for r in E.bed(s, exact=True).collect()] == [901, 895]


def test_abutting_intervals(spark):
    df = spark.createDataFrame([("s", 0, 5, "a"), ("s", 5, 9, "b")], "seq string, start long, end long, motif string")
    assert I.overlap_groups(df).select("island").distinct().count() == 2
    assert [(r.start, r.end) for r in I.merge_intervals(df).collect()] == [(0, 9)]
    assert I.overcovered(df).count() == 0 and I.disjoint_violations(df).count() == 0
    assert I.overlap_groups(df, width=2).select("island").distinct().count() == 2


def test_reverse_reads_are_lifted_and_sliced(spark):
    nt, _ = G.mock_genome("c", 400, [(100, "GGAAT")], 1)
    reads = G.sample_reads(spark, [("c", nt)], 30, G.ReadModel(80, 0.0, 0.05, 0.3, 0.05, 0.3), seed=5).cache()
    genome = spark.createDataFrame([("c", nt)], "name string, nt string")
    built = R.reconstruct(R.genome_pieces(reads, genome)).cache()
    pieces = R.slice_by_genome(built, spark.createDataFrame([("c", 150, 260)], "seq string, start long, end long")).collect()
    assert pieces
    text = {r.read: r.nt for r in reads.collect()}
    for p in pieces:
        assert p.g_text.replace("-", "").upper() == (D and (nt[p.start : p.end] if p.strand == "+" else nt[p.start : p.end][::-1].translate(str.maketrans("ACGT", "TGCA"))))
        assert text[p.read][p.r_start : p.r_end] == p.r_text.replace("-", "")
    lifted = I.lift(spark.createDataFrame([("c", 150, 260)], "seq string, start long, end long"), reads.select("read", "seq", "strand", "g_start", "g_end", "cigar"))
    assert lifted.filter("r_end < r_start").count() == 0 and lifted.count() == len(pieces)
    with pytest.raises(Exception, match="no cigar"):
        R.with_cigars(reads.select("read", "nt"), spark.createDataFrame([], "read string, cigar string")).collect()


def test_simulated_reads_and_genomes(spark):
    nt = "ACGT" * 30 + "N" * 12 + "GGAAT" * 30
    reads = G.sample_reads(spark, [("a", nt), ("b", "T" * 90)], 60, G.ReadModel(50), seed=2, strand="+", weights={"b": 0.0}, prefix="r").collect()
    assert len(reads) == 60 and {(r.seq, r.strand) for r in reads} == {("a", "+")} and all(r.nt == nt[r.g_start : r.g_end] for r in reads)
    with pytest.raises(Exception, match="fits nowhere"):
        G.sample_reads(spark, [("a", "ACGT")], 1, G.ReadModel(50)).collect()
    for text in (nt, "N" * 11 + nt, nt + "n" * 15):
        steps = G.step_reads(spark.createDataFrame([("a", text)], "name string, nt string"), 40, 25).collect()
        want = [s + k for s, e in G.segments_without(text, 10) for k in range(0, e - s - 39, 25)]
        assert sorted(r.g_start for r in steps) == want and all(r.nt == text[r.g_start : r.g_end].upper() for r in steps)
    arrays = G.drawn_arrays(["GGAAT", "ACG"], [60, 90], 12, 3)
    assert {n for n, _ in arrays} == {60, 90} and len(arrays) == 12
    genome, catalog = G.mock_genome("c", 400, arrays, 4, mixed=1.0)
    assert all("," in r["motif"] and r["end"] - r["start"] == r["rpt_len"] for r in catalog) and len(genome) == 400 + sum(n for n, _ in arrays)


def test_quota_sampling(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10).alias("length"))
    spec = spark.createDataFrame([(0, 4, 37, 500), (5, 9, 500, 500)], "lo long, hi long, out_count long, in_count long")
    taken = L.quota_sample(rows, spec, ["id"])
    assert {(r.lo, r.n) for r in taken.groupBy("lo").agg(F.count("*").alias("n")).collect()} == {(0, 37), (5, 500)}
    assert taken.select("id").distinct().count() == 537
    left = {(r.lo, r.out_count, r.in_count) for r in L.quota_remainders(spec, taken, rows).collect()}
    assert left == {(0, 0, 0), (5, 0, 0)}
    with pytest.raises(Exception, match="not the inverse"):
        L.bin_positions(spark.createDataFrame([(7, 1)], "pos long, n long"), "pos / 50", "bin * 40").collect()


def test_streams(spark, tmp_path):
    from loopweave.streaming import streams as S

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.fa").write_text(">x\n" + "AT" * 40 + "\n>y\nACGT\n")
    found = S.align_stream(S.fasta_stream(spark, str(src)), ["AT"], PRESETS["default"], thresholds(30))
    q = found.writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.name for r in spark.table("found").collect()] == ["x"]
    rows = tmp_path / "rows"
    for k in range(3):
        spark.range(k * 100, k * 100 + 100).select("id", (F.col("id") % 5).alias("length")).coalesce(1).write.mode("append").parquet(str(rows))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.PROVIDER)
    spec = spark.createDataFrame([(0, 2, 130, 300), (3, 4, 1000, 500), (9, 9, 5, 5)], "lo long, hi long, out_count long, in_count long")

    def run():
        stream = spark.readStream.schema("id long, length long").option("maxFilesPerTrigger", 1).parquet(str(rows))
        out = S.quota_stream(stream, spec).writeStream.format("parquet").option("path", str(tmp_path / "sink"))
        out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / "sink"))
        assert got.count() == got.select("id").distinct().count() and got.filter("length < lo or length > hi").count() == 0
        return {r.lo: r["count"] for r in got.groupBy("lo").count().collect()}

    assert run() == {0: 130, 3: 120}  # three batches: the quota of 0 to 2 is met, of 3 to 4 all 120 rows are taken
    left = sorted(map(tuple, S.quota_left(spark, spec, str(tmp_path / "ck")).collect()))
    assert left == [(0, 2, 0, 120), (3, 4, 880, 380), (9, 9, 5, 5)]
    # started again with more files, the query goes on from its state; the sink is not read, it may even be emptied
    for k in range(3, 5):
        spark.range(k * 100, k * 100 + 100).select("id", (F.col("id") % 5).alias("length")).coalesce(1).write.mode("append").parquet(str(rows))
    assert run() == {0: 130, 3: 200}
    assert sorted(map(tuple, S.quota_left(spark, spec, str(tmp_path / "ck")).collect()))[:2] == [(0, 2, 0, 0), (3, 4, 800, 300)]


def test_entry_without_the_training_subpackage():
    """A process in which the training modules can't be found: the entry imports and has all other queries."""
    script = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["loopweave", "llm"] or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
from loopweave.plans import queries
assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLES)
assert "loopweave.llm" not in sys.modules
"""
    root = Path(__file__).resolve().parents[1]
    subprocess.run([sys.executable, "-c", script], check=True, cwd=root, env=os.environ | {"PYTHONPATH": str(root)})


def test_one_fasta_file_is_read_in_many_tasks(spark, tmp_path):
    rnd = random.Random(5)
    records = [("r%d extra words" % k, "".join(rnd.choice("ACGTNacgt") for _ in range(rnd.randint(0, 9000)))) for k in range(600)]
    text = "".join(f">{h}\n" + "".join(f"{s[k:k + 70]}\n" for k in range(0, len(s), 70)) for h, s in records)
    (tmp_path / "big.fa").write_text(text)
    (tmp_path / "small.fa").write_text("ACG\n>b\nacgtx" + "\n>c\nAC\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = T.read_fasta(spark, str(tmp_path / "big.fa"))
        assert df.rdd.getNumPartitions() >= 8
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan  # bases are not moved
        got = sorted((r.seq_ordinal, r.name, r.nt) for r in df.collect())
        assert got == [(k + 1, h.split()[0], s.upper()) for k, (h, s) in enumerate(records)]
        some = T.read_fasta(spark, str(tmp_path / "big.fa"), skip=200, head=210, upper=False).collect()
        assert sorted((r.seq_ordinal, r.nt) for r in some) == [(k + 1, records[k][1]) for k in range(199, 210)]
        assert [r.seq_ordinal for r in T.read_fasta(spark, str(tmp_path / "big.fa"), names=["r7"]).collect()] == [8]
        # records that are passed over are not decoded: the bad base of b is never looked at
        both = T.read_fasta(spark, str(tmp_path), names=["c", "sequence1", "r0"])
        assert sorted((r.seq_ordinal, r.name, len(r.nt)) for r in both.collect()) == sorted([(1, "sequence1", 3), (3, "c", 2), (1, "r0", len(records[0][1]))])
        with pytest.raises(Exception, match="bad character"):
            T.read_fasta(spark, str(tmp_path / "small.fa")).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
