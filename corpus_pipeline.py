"""From raw documents to packed training sequences, one operator of chatloom.llm per stage.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is written and read again as
the next one's docs. All but the last return the columns of documents, extra ones included, whatever
their names. Null and empty texts have no language and go with the first stage. Repeated rows count as
copies: one stays. Rows without a doc_id are kept or dropped for their text like others, and train no
classifier. Very long texts are read in whole, cut only into sequences. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import decontaminate, jaccard_join, language_id, packing, quality
from chatloom.llm.workspace import Workspace
from chatloom.runtime import ship


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in."""
    ship(spark)
    return language_id.accepted_documents(docs, language_id.learn(docs.where(~language_id.held_out())))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier learned from labels.quality does not reject."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted_documents(docs, quality.learn(docs, labels.where(~quality.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in fixed-length sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", languages),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("best-fit packing", packed),
]

#: The stages learn models and tokenise, which SQL cannot express; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs
