"""From raw documents to packed training sequences: filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Defined results
* null or empty texts, and texts without words: the quality rules reject them;
* rows without a doc_id go through every stage like others; repeated rows are near copies, of which one stays;
* ties between copies: the smallest (doc_id, digest of the text) stays; very long texts are judged and packed whole;
* extra columns are kept up to mixing, also such as are named like results of an operator; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loopweave.llm import mixing, near_dedup, packing, quality_rules, toxicity
from loopweave.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go."""
    return quality_rules.stage(spark, docs, sf_dir)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the classifier rejects go."""
    return toxicity.stage(spark, docs, sf_dir)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: one document of each group stays."""
    return near_dedup.stage(spark, docs, sf_dir)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix: documents as often as their source's target asks."""
    return mixing.stage(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: a row for each piece of a document in a sequence."""
    return packing.op3_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("toxicity", clean),
    ("near_dedup", unique),
    ("mixing", mixed),
    ("packing", packed),
]

#: Training of a classifier and sketches have no SQL; the pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
