"""The aligner in SQL gives the rows of its DataFrame form."""

import pytest
from pyspark.sql import functions as F

from loopweave.functions.config import PRESETS, thresholds
from loopweave.operators import align as A
from loopweave.operators import table_functions
from loopweave.plans import queries as P

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seqs(spark):
    table_functions.register(spark)
    df = P._sequences(spark, DIR).withColumn("extra", F.lit("x"))
    df = df.unionByName(spark.createDataFrame([(-1, "none", None, "x"), (-2, None, "GGAAT" * 30, "x")], "seq_ordinal long, name string, nt string, extra string")).repartition(5)
    df.createOrReplaceTempView("seqs")
    return df


def test_sql_equals_the_data_frame(spark, seqs):
    want = A.align_repeats(seqs, ["AT", "pair:GGAAT"], PRESETS["historical"], thresholds(30, 0.8), "forward")
    got = spark.sql("SELECT * FROM align_repeats(TABLE(seqs), array('AT', 'pair:GGAAT'), preset => 'historical', min_length => 30, min_ratio => 0.8, strands => 'forward')")
    rows = sorted(map(str, got.collect()))
    assert got.columns == want.columns and rows == sorted(map(str, want.collect())) and len(rows) > 1
    assert "Exchange" not in spark.sql("SELECT * FROM align_repeats(TABLE(SELECT 1L seq_ordinal, 'a' name, 'AC' nt), array('AT'))")._jdf.queryExecution().executedPlan().toString()


def test_with_other_sql(spark, seqs):
    got = spark.sql("SELECT motif, count(*) AS n FROM align_repeats(TABLE(SELECT * FROM seqs WHERE seq_ordinal = -2), motifs => array('GGAAT'), min_length => 100) GROUP BY motif")
    assert [tuple(r) for r in got.collect()] == [("GGAAT", 1)]
    assert spark.sql("SELECT * FROM align_repeats(TABLE(SELECT * FROM seqs WHERE false), motifs => array('GGAAT'))").count() == 0


@pytest.mark.parametrize(
    ("call", "error"),
    [
        ("TABLE(SELECT 1L seq_ordinal, 'x' name), array('AT')", "needs a column nt"),
        ("TABLE(seqs), array('AT'), preset => 'none'", "unknown preset"),
        ("TABLE(seqs), array('AXT')", "not a motif"),
        ("TABLE(seqs), array('AT'), strands => 'up'", "strands must be"),
        ("array('AT'), array('AT')", "must be a table"),
    ],
)
def test_wrong_arguments(spark, seqs, call, error):
    with pytest.raises(Exception, match=error):
        spark.sql(f"SELECT * FROM align_repeats({call})").collect()


def test_query(spark):
    assert sorted(map(str, P.QUERIES["repeats_by_sql"](spark, DIR).collect())) == sorted(map(str, P.QUERIES["align_repeats"](spark, DIR).collect()))
