"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``. Rows whose
columns are null go on unless a stage's operator says otherwise; an empty table stays empty; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from xpspark.llm import bpe, common, decontaminate, line_dedup, minhash, queries, toxicity


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id ``gone`` doesn't hold; only ids are joined with the texts."""
    (key,) = common.unused(docs, 1)
    return docs.join(gone.select(F.col("doc_id").alias(key)).distinct(), F.col("doc_id") == F.col(key), "left_anti")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the toxicity grammar, learned from their labels, does not reject."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without blocks of lines that repeat; ``n_chars`` follows the text."""
    out = line_dedup.dedup(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    A kept document's rows that repeat are all kept.
    """
    return without(docs, minhash.components(docs).where("NOT kept"))


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item; rows without id stay."""
    found = decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated AND doc_id IS NOT NULL"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of ids and decoded text."""
    return queries.bpe_digest(bpe.encode(docs, queries.tokenizer_path()))


STAGES = [("toxicity", clean), ("line_dedup", unrepeated_lines), ("near_dedup", one_of_each), ("decontamination", untested), ("bpe", encoded)]

#: Stems are learned and near duplicates found by hashing, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
