"""The DNA view keeps plain letters alone, and takes whole runs of others out."""

from loopweave.plans import views as V


def test_letters_that_upper_case_would_make_are_not_bases(spark, tmp_path):
    texts = ["aCgTn", "ẗẚÀçĝ", "x a\n\nc - GGß t", "", None, "\U0001f600áT"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = V.dna(spark, str(tmp_path))
    assert [r.seq for r in found.orderBy("doc_id").collect()] == ["".join(c for c in (t or "").translate(str.maketrans("acgt", "ACGT")) if c in "ACGT") for t in texts]
    assert "translate(" not in found._jdf.queryExecution().executedPlan().toString()  # letter by letter before
