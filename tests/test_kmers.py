"""Words counted for each key: repeated and null keys, and what moves."""

import random
from collections import Counter

from pyspark.sql import functions as F

from loopweave.functions import dna as D
from loopweave.operators import kmers as W
from loopweave.plans import queries as P


def sequences(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, 1, 2, 3, 40]), "".join(rnd.choice("ACGT") for _ in range(rnd.choice([0, 3, 4, 5, 6, 30, 90])))) for _ in range(60)]
    return spark.createDataFrame([*rows, (7, None), (8, "")], "id long, seq string").repartition(5)


def test_neighbours_of_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS", 50)
    df = sequences(spark)
    want = df.select("id", F.explode(D.kmers(F.col("seq"), 4)).alias("m")).select("id", F.explode(D.motif_neighbors(F.col("m"))).alias("t")).groupBy("id", "t").count()
    got = W.neighbor_counts(df, "id", "seq", 4).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.collect()))


def test_canonical_words_of_repeated_keys(spark):
    df = sequences(spark)
    want = df.filter("seq is not null").select("id", F.explode(D.kmers(F.col("seq"), 3)).alias("m")).distinct().withColumn("c", D.canonical_motif(F.col("m"))).select("id", "m", "c.motif", "c.strand")
    got = W.canonical_words(df, "id", "seq", 3).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want.collect()))


def test_only_sequences_move(spark):
    for name in ("motif_neighbors", "canonical_motif"):
        plan = P.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan and "Generate" not in plan


def test_repeated_documents_give_their_words_once(spark, tmp_path):
    docs = [(1, "acgtacgtaa"), (1, "acgtacgtaa"), (2, "ggggggg")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = P.QUERIES["canonical_motif"](spark, str(tmp_path)).collect()
    assert len(got) == len({(r.doc_id, r.motif) for r in got}) == 6
