"""A corpus pipeline: language, quality, near copies, benchmark passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All stages but the last return rows of documents
with all their columns. Extra columns, whatever their names, pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerloom.llm import decontam, langid, packing, quality, simhash
from offerloom.llm.common import Query, table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language. Null texts, texts without a letter and those in other languages go."""
    return langid.drop_unknown(docs, langid.train(docs.select("doc_id", "text", "lang")))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labels of its learning folds, scores at the threshold or above."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.drop_poor(docs, quality.train(docs.select("doc_id", "text"), labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of every group of near copies."""
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark table."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents in sequences of a fixed length."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("quality", quality_filter), ("near_copies", near_copies), ("decontamination", decontaminate), ("packing", pack)]

#: Filters, models and token ids are beyond SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs


QUERY = Query(run, ORACLE_SQL)
